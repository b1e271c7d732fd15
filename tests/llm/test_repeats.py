"""Suffix-array dedup against a plain scan of all 100-byte windows."""

import hashlib
import random

import numpy as np
import pytest
from wakeline.llm import repeats

SCHEMA = "doc_id long, text string, kept string"


def brute(docs):
    """docs: (id, bytes) in document order -> id -> (n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), {}
    for ident, text in docs:
        gone = bytearray(len(text))
        for p in range(len(text) - 99):
            w = text[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\x01" * 100
            seen.add(w)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out[ident] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df).collect()}


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [say(40) for _ in range(4)] + ["ab" * 120, "x" * 400]
    rows = []
    for i in range(60):
        parts = [say(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            cut = r.randint(0, len(s) // 3)
            parts += [s[cut:], say(r.randint(0, 20))]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, rows[7][1]), (501, rows[7][1]), (502, ""), (503, None), (504, "short"), (505, "y" * 5000), (506, "z" * 99), (507, "z" * 100), (508, "z" * 101)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute([(i, (t or "").encode()) for i, t in sorted(rows)])


def test_hot_passage_in_every_document(spark):
    """An anchor far above the hot limit, shifted differently everywhere."""
    r = random.Random(5)
    passage = " ".join(str(r.randint(0, 10**6)) for _ in range(60))
    rows = [(i, f"{r.random()} {passage[r.randint(0, 200):]} {r.random()}") for i in range(80)]
    assert found(spark, rows) == brute([(i, t.encode()) for i, t in rows])


def test_null_ids_come_last_and_repeated_rows_keep_one(spark):
    text = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(None, text, ""), (4, text, ""), (4, text, "")], SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id, r.n_removed) for r in repeats.remove_repeats(df).collect())
    assert [(i, n) for _, i, n in got] == [(4, 0), (4, len(text)), (None, len(text))]
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def test_kept_bytes(spark):
    text = " ".join(map(str, range(100)))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in repeats.remove_repeats(df, with_kept=True).collect()}
    assert got == {1: text.encode(), 2: b"head  tail"}


def test_later_copies_and_neighbours():
    r = np.random.default_rng(3)
    for alphabet in (1, 2, 4):
        data = r.integers(0, alphabet, 700).astype(np.uint8)
        starts = np.arange(len(data) - 99)
        seen, want = set(), []
        for p in starts:
            w = data[p : p + 100].tobytes()
            want.append(w in seen)
            seen.add(w)
        assert repeats.later_copies(data, starts).tolist() == want
    position = r.permutation(200)
    before, after = repeats.smaller_neighbours(position)
    for k, x in enumerate(position):
        assert before[k] == max((i for i in range(k) if position[i] < x), default=-1)
        assert after[k] == min((i for i in range(k + 1, 200) if position[i] < x), default=200)


def test_segments_of_very_long_texts(monkeypatch):
    """Windows across segment borders are found once."""
    r = random.Random(9)
    data = bytes(r.choice(b"abc") for _ in range(5000))
    whole = set()
    for _, at, lead, n, h in repeats.text_runs([data]):
        whole |= {(int(a) + k, int(a) + int(x), int(y)) for a, x, m, y in zip(at, lead, n, h, strict=True) for k in range(int(m))}
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    cut = set()
    for _, at, lead, n, h in repeats.text_runs([data]):
        cut |= {(int(a) + k, int(a) + int(x), int(y)) for a, x, m, y in zip(at, lead, n, h, strict=True) for k in range(int(m))}
    assert {(p, h) for p, _, h in whole} == {(p, h) for p, _, h in cut} and {p for p, *_ in whole} == set(range(4901))


def test_rows_of_one_hash_are_told_apart(spark, monkeypatch):
    """Different texts whose rows have one hash are not taken for repeated rows."""
    monkeypatch.setattr(repeats.F, "xxhash64", lambda *c: repeats.F.lit(5).cast("long"))
    r = random.Random(3)
    a, b = ("".join(r.choice("abcdef") for _ in range(400)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a[:200] + b), (None, b)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = sorted((x.doc_id or 99, x.n_bytes, x.n_removed) for x in repeats.remove_repeats(df).collect())
    assert got == [(1, 400, 0), (1, 400, 0), (2, 600, 600), (99, 400, 400)]
