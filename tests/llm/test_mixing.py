"""Mixing: targets against a plain water-filling, and what each document and source gets."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from wakeline.llm import mixing, queries

from tests.compare import check

SCHEMA = "doc_id long, text string, source string, target string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, weights, cap=3):
    """Targets: share what is left by weight, clamp whoever is above its cap, again until none is."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            return [float(cap * sizes[i]) if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    names = sorted({r.choice(["a", "B", "é", "z", ""]) + str(r.randint(0, 9)) for _ in range(r.randint(1, 9))}) + [None] * (seed % 2)
    sizes = [r.choice([0, 1, 5, 100, 10_000]) for _ in names]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    got = {x.source: x.target for x in mixing.targets(df).collect()}
    want = dict(zip(names, water(sizes, [(k % 3) + 1 for k in range(len(names))]), strict=True))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want), (sizes, got, want)


def corpus(n=3000, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choices(["big", "mid", "small", None], [70, 20, 8, 2])[0]
        rows.append((i, None if i % 97 == 0 else "w " * r.choice([0, 1, 10, 50, 200]), source, "clash"))
    return rows + [(n, "one\x0btwo\x1cthree x", "small", "clash")]


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert len(got) == len(rows)
    by = {}
    for i, text, source, _ in rows:
        x = got[i]
        assert x.size == len(WORD.findall(text or "")) and x.taken <= 3 * x.size and x.taken % max(1, x.size) == 0 and x.source == source
        by.setdefault(source, []).append(x)
    for source, xs in by.items():
        taken, target = sum(x.taken for x in xs), xs[0].target
        assert all(x.target == target and x.source_size == sum(y.size for y in xs) for x in xs)
        assert abs(taken - target) <= 200, (source, taken, target)
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7).orderBy("text")).collect()}
    assert again == {i: x.taken for i, x in got.items()}


def test_mixed_rows_are_what_mix_says(spark):
    rows = corpus(800, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.times for r in mixing.mix(df).collect() if r.times}
    assert {(r.doc_id, r.text, r.source) for r in out.collect()} <= {(i, t, s) for i, t, s, _ in rows}


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c", "s", ""), (1, "a b", "s", ""), (1, "a b", "s", ""), (2, None, None, "")], SCHEMA)
    got = [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 7, 7.0, 3), (1, 2, 7, 7.0, 2), (1, 2, 7, 7.0, 2), (2, 0, 0, 0.0, 0)], key=str)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def near_target(rows, slack):
    """Whether each source's taken words are within slack of its target, and no row is beyond three times its size."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for xs in by.values():
        assert abs(sum(x.taken for x in xs) - xs[0].target) <= slack, (xs[0].source, sum(x.taken for x in xs), xs[0].target)
        assert all(0 <= x.taken <= 3 * x.size for x in xs)


@pytest.mark.parametrize("ident", [7, None])
def test_rows_of_one_id_are_taken_one_by_one(spark, ident):
    ten = "w " * 10
    rows = [(ident, ten, "a", "")] * 1000 + [(i, ten, "b", "") for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == 2000
    near_target(got, 10)
    mixed = {r.source: r["count"] for r in mixing.mixed(df).groupBy("source").count().collect()}
    assert mixed == {"a": 666, "b": 1333}


@pytest.mark.parametrize("ident", [7, None])
def test_different_texts_of_one_id(spark, ident, monkeypatch):
    monkeypatch.setattr(mixing, "CROWD", 64)  # so that the crowded bucket is cut
    rows = [(ident, f"t{i} " * (1 + i % 7), "a", "") for i in range(1500)] + [(i, "x y z", "b", "") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = mixing.mix(df).collect()
    near_target(got, 8)
    taken = sorted((r.source, r.size, r.taken) for r in got)
    assert taken == sorted((r.source, r.size, r.taken) for r in mixing.mix(df.repartition(6)).collect())
    mixed = {r.source: r["count"] for r in mixing.mixed(df).groupBy("source").count().collect()}
    assert mixed == {s: sum(r.times for r in got if r.source == s) for s in ("a", "b")}


def test_sql_on_repeated_and_null_ids(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([7, None, i]), "w " * r.choice([0, 3, 10]) + r.choice("xyz"), r.choices(["a", "b", None], [6, 3, 1])[0]) for i in range(6000)]
    pq.write_table(spark.createDataFrame(rows, "doc_id long, text string, source string").toArrow(), tmp_path / "documents.parquet")
    assert check(spark, str(tmp_path), queries.op4_source_mixing, queries.OP4_SQL) == 6000


def test_bucket_does_not_overflow(spark):
    x = spark.range(1).select(mixing.bucket(F.lit((1 << 40) - 1), F.lit(1 << 40)).alias("b"), mixing.bucket(F.lit(123_456_789_012), F.lit(9_999_999_999)).alias("c")).first()
    assert (x.b, x.c) == ((1 << 40) - 1, 123_456_789_012 * 9_999_999_999 >> 40)
