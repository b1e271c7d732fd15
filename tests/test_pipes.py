"""Pipes on small frames: order, keys, nulls, counts, hosts, merging of partial results."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.api import Config, Engine
from wakeline.errors import QueryError
from wakeline.operators import pipes
from wakeline.plans.parser import Dialect

FRAME = "__ord long, __type string, __time long, name string, n long, hostname string"
ROWS = [
    (1, "a", 1, "Beta", 3, "h1"), (2, "a", 2, "alpha", None, "h2"), (3, "b", 3, "BETA", 1, "h1"), (4, "a", 4, None, -2, "h3"), (5, "b", 5, "gamma", 0, None), (6, "a", 6, "beta", 3, "h2"), (7, "a", 7, "", 5, "h1"), (8, "b", 8, "Alpha", 2, "h3"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, frame=spark.createDataFrame(ROWS, FRAME).repartition(3))


def ids(engine, text):
    return [r["__ord0"] for r in engine.raw(text, engine.frame.withColumn("__ord0", F.col("__ord"))).orderBy("__ord").collect()]


@pytest.mark.parametrize("text, want", [
    ("any where true | head 3", [1, 2, 3]), ("any where true | tail 3", [6, 7, 8]), ("any where true | head", list(range(1, 9))), ("any where true | unique name", [1, 2, 4, 5, 7]), ("any where true | unique name, hostname", [1, 2, 4, 5, 6, 7, 8]), ("any where true | unique length(name) > 4", [1, 2, 4]),
    ("any where true | sort name", [4, 7, 2, 8, 1, 3, 6, 5]), ("any where true | sort n", [4, 2, 5, 3, 8, 1, 6, 7]), ("any where true | sort name, n | head 3", [4, 7, 2]), ("any where true | sort n | tail 2", [6, 7]), ("any where true | sort n | unique name | head 4", [4, 2, 5, 3]), ("any where true | tail 5 | head 2", [4, 5]), ("any where true | filter n > 1 | tail 2", [7, 8]),
    ("a where true | sort name | sort n | head 4", [4, 2, 1, 6]), ("any where n == 100 | unique name", []),
])
def test_orders(engine, text, want):
    assert ids(engine, text) == want


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_count_totals(engine):
    got = engine.raw("any where true | count").drop("__ord").collect()
    assert [r.asDict() for r in got] == [{"key": "totals", "count": 8, "hosts": ["h1", "h2", "h3"], "total_hosts": 3}]
    assert engine.raw("any where n == 100 | count").collect()[0]["count"] == 0


def test_count_by_keys(engine):
    got = engine.raw("any where true | count name").orderBy("__ord").collect()
    # folded keys, first spelling; null and '' are one key; by count, then key
    assert [(r.key, r["count"], r.total_hosts, r.hosts) for r in got] == [("gamma", 1, None, None), ("", 2, 2, ["h1", "h3"]), ("alpha", 2, 2, ["h2", "h3"]), ("Beta", 3, 2, ["h1", "h2"])]
    assert [r.percent for r in got] == [1 / 8, 2 / 8, 2 / 8, 3 / 8]
    two = engine.raw("any where true | count name, n | tail 1").collect()
    assert [(r.key, r["count"]) for r in two] == [(["Beta", "3"], 2)]
    assert [(r.key, r["count"]) for r in engine.raw("any where true | count n | filter count > 1 | sort key").orderBy("__ord").collect()] == [(0, 2), (3, 2)]


def test_unique_count(engine):
    got = engine.raw("any where true | unique_count name").orderBy("__ord").collect()
    assert [(r["__ord"], r.name, r["count"], r.total_hosts) for r in got] == [(1, "Beta", 3, 2), (2, "alpha", 2, 2), (4, None, 1, 1), (5, "gamma", 1, None), (7, "", 1, 1)] and "hostname" not in got[0]
    # an earlier count is summed
    again = engine.raw("any where true | count name | unique_count count > 1").orderBy("__ord").collect()
    assert [(r.key, r["count"], r.percent) for r in again] == [("gamma", 1, 1 / 8), ("", 7, 7 / 8)]


def test_pipes_on_matches(engine):
    df = engine.raw("sequence [a where true] [b where true] | filter events[1].n >= 1 and name != null | unique events[1].hostname, n | sort events[1].n")
    assert [tuple(e["__ord"] for e in r.events) for r in df.orderBy("__ord").collect()] == [(2, 3), (7, 8)]
    assert [(r.key, r["count"]) for r in engine.raw("sequence [a where true] [b where true] | count events[1].name").orderBy("__ord").collect()] == [("Alpha", 1), ("BETA", 1), ("gamma", 1)]
    got = engine.raw("sequence [a where true] [b where true] | unique_count length(events[1].name) > 4").orderBy("__ord").collect()
    assert [(r["count"], len(r.events)) for r in got] == [(1, 2), (2, 2)]


def test_merge_of_partial_counts_equals_one_count(spark, engine):
    r = random.Random(1)
    data = [(k, "a", k, r.choice(["x", "X", "y", None]), r.randint(0, 2), f"h{r.randint(0, 5)}") for k in range(300)]
    whole = spark.createDataFrame(data, FRAME)
    for text in ("any where true | count", "any where true | count n", "any where true | count n | filter count > 20 | head 2", "any where true | unique_count n", "any where true | unique n | count"):
        cut = text.split(" | ")
        at = max(k for k, x in enumerate(cut) if x.startswith(("count", "unique_count")))
        parts = None
        for k in range(6):
            p = engine.raw(" | ".join(cut[: at + 1]), whole.where(F.col("hostname") == f"h{k}"))
            parts = p if parts is None else parts.unionByName(p)
        merged = engine.merge(parts, text)
        want = engine.run(text, whole)
        shown = [c for c in ("key", "count", "percent", "total_hosts", "hosts") if c in want.columns and c in merged.columns]
        if text.endswith("| unique n | count"):
            assert merged.collect()[0]["count"] >= want.collect()[0]["count"]  # parts count what they saw
            continue
        key = lambda x: str(tuple(x))
        assert sorted(rows(merged.select(*shown)), key=key) == sorted(rows(want.select(*shown)), key=key), text


def test_post_processing(engine):
    found = engine.raw("sequence [a where true] [b where true]")
    assert engine.post_process(found, "| filter events[1].n >= 1 | count").collect()[0]["count"] == 2
    assert engine.post_process(found, "| filter n >= 1 | head 9", several=False).select("n").collect() == [(5,)]


def test_custom_pipe(engine):
    @pipes.register("nth")
    def nth(flow, args):
        return flow.with_df(flow.df.where(F.col("__ord") % args[0].value == 0))

    try:
        assert ids(engine, "any where true | nth 3 | head 1") == [3]
    finally:
        del pipes.PIPES["nth"]
    with pytest.raises(QueryError):
        engine.raw("any where true | nth 3")


def test_no_task_sees_all_rows_in_sort(engine):
    plan = engine.raw("any where true | sort name")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan


def test_case_sensitive_keys(spark, engine):
    e = Engine(spark, Config(case_sensitive=True), engine.frame)
    assert ids(e, "any where name != null | unique name") == [1, 2, 3, 5, 6, 7, 8]


def test_implied_base_and_booleans(spark, engine):
    assert engine.raw("| count").collect()[0]["count"] == 8
    e = Engine(spark, Config(dialect=Dialect(implied_booleans=True)), engine.frame)
    assert ids(e, "any where n and name") == [1, 3, 6, 8]
