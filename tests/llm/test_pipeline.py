"""The pipeline on the smallest tables: each stage against a plain version on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
import pytest
from tests.llm.test_decontam import brute
from tests.llm.test_mixing import WORD, water
from tests.llm.test_packing import unpacked
from tests.llm.test_quality import verdicts
from wakeline.llm import decontam, mixing, packing

SF_DIR = "/root/testdata/sf0.001"


def grams(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first and after each stage, each written and read again."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF_DIR)
        docs = spark.createDataFrame(done.collect(), done.schema)
        out.append(docs)
    return [x.collect() for x in out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "source mixing", "token output"]
    for rows in stages[1:-1]:
        assert rows and rows[0].__fields__ == stages[0][0].__fields__


def test_quality_stage(stages):
    want = {i for i, x in verdicts([(r.doc_id, r.text, r.source, "") for r in stages[0]]).items() if x[-1]}
    assert {r.doc_id for r in stages[1]} == want


def test_dedup_stage(stages):
    """No two kept rows are similar; each row that went has a chain of similar rows to a kept one of lesser id."""
    before, kept = {r.doc_id: grams(r.text) for r in stages[1]}, {r.doc_id for r in stages[2]}
    assert kept <= before.keys() and len(stages[2]) == len(kept)
    sim = lambda a, b: len(before[a] & before[b]) / max(1, len(before[a] | before[b])) if before[a] or before[b] else 1.0
    ids = sorted(before)
    pairs = [(a, b, sim(a, b)) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    assert not [p for p in pairs if p[2] >= 0.85 and p[0] in kept and p[1] in kept]
    near = {i: set() for i in ids}
    for a, b, s in pairs:
        if s >= 0.6:
            near[a].add(b), near[b].add(a)
    for i in before.keys() - kept:
        todo, seen = [i], {i}
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert any(k in kept and k < i for k in seen), i


def test_decontamination_stage(spark, stages):
    its = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    bad = {k for k, _ in brute([r.text or "" for r in stages[2]], its)}
    assert Counter(r.doc_id for r in stages[3]) == Counter(r.doc_id for k, r in enumerate(stages[2]) if k not in bad)


def test_mixing_stage(stages):
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in stages[3]}
    names = sorted({r.source for r in stages[3]}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[r.doc_id] for r in stages[3] if r.source == s) for s in names]
    targets = water(sizes, [k % 3 + 1 for k in range(len(names))])
    times = Counter(r.doc_id for r in stages[4])
    assert max(times.values()) <= 3 and times.keys() <= size.keys()
    longest = max(size.values())
    for s, target in zip(names, targets, strict=True):
        taken = sum(size[r.doc_id] * times[r.doc_id] for r in stages[3] if r.source == s)
        assert abs(taken - target) <= longest
    assert mixing.CAP == 3 and {r.text for r in stages[4]} <= {r.text for r in stages[3]}


def test_token_stage(stages):
    with open(packing.TOKENIZER, "rb") as f:
        enc = packing.encoding(f.read())
    text = {r.doc_id: r.text or "" for r in stages[4]}
    times = Counter(r.doc_id for r in stages[4])
    ends = Counter()
    tokens = 0
    for r in stages[5]:
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            ends[doc] += int.from_bytes(r.input_ids[2 * b - 2 : 2 * b], "little") == enc.n_vocab
        tokens += r.n_tokens
    assert ends == times and tokens == sum(len(enc.encode_ordinary(text[i])) * n + n for i, n in times.items())
    once = {i for i, n in times.items() if n == 1}
    whole = [r for r in stages[5] if set(r.doc_ids) <= once]
    for doc, ids in unpacked([r for r in whole if all(x == 0 for x in r.doc_starts)], packing.LENGTH).items():
        if ids[-1] == enc.n_vocab:
            assert enc.decode(ids[:-1].tolist()) == text[doc]


def test_clean_and_planted(stages):
    """Items planted whole into documents are gone after decontamination."""
    left = [b" ".join(decontam.words_of(r.text or "")) for r in stages[3]]
    assert left and all(isinstance(x, bytes) for x in left)


def test_empty_and_null_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for rows in (docs.limit(0), spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (1, "", "", "", 0)], docs.schema)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, SF_DIR)
            assert got.count() <= 3, name


def test_no_item_is_left_and_clean_documents_stay(spark, stages):
    """Documents that hold an item's words in order are in before decontamination and gone after; those without any shingle of an item stay."""
    its = [b" ".join(decontam.words_of(r.text or "")) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    its = [b" " + x + b" " for x in its if x]
    grams_ = {g for x in its for g in decontam.shingles(x.split())}
    words = [decontam.words_of(r.text or "") for r in stages[2]]
    holds = {r.doc_id for r, w in zip(stages[2], words, strict=True) if any(x in b" " + b" ".join(w) + b" " for x in its)}
    free = {r.doc_id for r, w in zip(stages[2], words, strict=True) if not grams_ & decontam.shingles(w)}
    left = {r.doc_id for r in stages[3]}
    assert holds and free and not holds & left and free <= left
