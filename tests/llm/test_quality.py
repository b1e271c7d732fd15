"""Quality rules against a plain implementation; the SQL of the query is compared in test_oracle.py."""

import random
import re

from wakeline.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string"


def plain(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    full = [x for x in lines if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in full[:i] for i, x in enumerate(full)), len(covered)


def corpus(seed=3):
    r = random.Random(seed)
    out = []
    for i in range(150):
        n = r.choice([0, 3, 19, 20, 60, 120])
        words = [r.choice(["a", "be", "çé", "日本", "#x", "<b>", "x|y", "$5", "no break"]) + (str(r.randint(0, 50)) if r.random() < 0.8 else "") for _ in range(n)]
        if n >= 60 and r.random() < 0.5:
            words[30:50] = words[5:25]
        text = "".join(w + r.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b"]) for w in words)
        out.append((i, text, r.choice(["good", "good", "bad", None]), "clash"))
    junk = [(1000 + i, "too short", "spam", "clash") for i in range(40)] + [(2000, " ".join(f"w{k}" for k in range(50)), "spam", "clash")]
    return out + junk + [(3000, None, None, None), (3001, "\n\n \n", "", "clash"), (3002, "one line\n" * 50, "good", "clash"), (3003, "q " * 5000, "good", "clash")]


def verdicts(rows):
    f = {i: plain(t) for i, t, *_ in rows}
    failed = {i: x[0] < 20 or 100 * x[4] > 30 * x[0] for i, x in f.items()}
    hosts = {}
    for i, _, h, _ in rows:
        hosts.setdefault(h, []).append(failed[i])
    m = sum(failed.values()) / len(rows)
    rates = [sum(x) / len(x) for x in hosts.values()]
    mean = sum(rates) / len(rates)
    s2 = sum((x - mean) ** 2 for x in rates) / len(rates)
    k = 1e6 if s2 <= 0 else max(1.0, min(1e6, m * (1 - m) / s2 - 1))
    rate = {h: (sum(x) + m * k) / (len(x) + k) for h, x in hosts.items()}
    return {i: (*f[i], failed[i], not failed[i] and not rate[h] > 0.5) for i, _, h, _ in rows}


def test_judge_matches_plain(spark):
    rows = corpus()
    got = {r.doc_id: (*(r[c] for c in quality.FEATURES), r.base_failed, r.kept) for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = verdicts(rows)
    assert got == want
    assert not want[2000][5] and not want[2000][6], "a good document of a bad host goes with its host"


def test_keep_good_keeps_what_judge_keeps(spark):
    rows = corpus(8)
    df = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in verdicts(rows).items() if x[-1]}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)), "s", "")] * 3, SCHEMA)
    assert quality.judge(df).count() == 3 and quality.keep_good(df).count() == 3
    assert quality.judge(df.limit(0)).count() == 0 and quality.keep_good(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{k}" for k in range(300_000))
    got = quality.judge(spark.createDataFrame([(1, text, "s", ""), (2, text + " " + text, "s", "")], SCHEMA)).collect()
    assert {r.doc_id: (r.n_words, r.n_repeat_words, r.base_failed) for r in got} == {1: (300_000, 0, False), 2: (600_000, 600_000, True)}
