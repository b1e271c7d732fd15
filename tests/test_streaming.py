"""Streaming queries: files arrive in micro-batches; results equal those of the batch engine."""

import json
import os
import random

import pytest

from tests import machines
from wakeline.api import Config, Engine
from wakeline.errors import CompileError
from wakeline.operators.patterns import Timing
from wakeline.plans.parser import Dialect

SCHEMA = "__ord long, __time long, __type string, k string, x long"


def events(seed=1, n=120):
    r, time, out = random.Random(seed), 0, []
    for k in range(n):
        time += r.choice([0, 1, 1, 4])
        out.append({"__ord": k, "__time": time, "__type": r.choice("abc"), "k": r.choice(["p", "P", "q"]), "x": r.randint(0, 3)})
    return out


def streamed(spark, tmp_path, rows, text, mode="append", batches=4, config=Config(ticks=1), schema=SCHEMA, **options):
    source = tmp_path / "in"
    source.mkdir()
    size = -(-len(rows) // batches)
    for b in range(batches):
        (source / f"{b}.json").write_text("\n".join(map(json.dumps, rows[b * size : (b + 1) * size])))
        os.utime(source / f"{b}.json", (1_000_000 + b, 1_000_000 + b))  # files are taken by their time
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = Engine(spark, config).stream(text, df, **options)
    name = f"t{abs(hash((text, mode))) % 10**9}"
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).collect()


def test_filters(spark, tmp_path):
    rows = events()
    got = streamed(spark, tmp_path, rows, "a where x > 1 | filter k == 'P'")
    assert sorted(r["__ord"] for r in got) == [e["__ord"] for e in rows if e["__type"] == "a" and e["x"] > 1 and e["k"] in "pP"]


@pytest.mark.parametrize("text, options", [
    ("sequence by k with maxspan=6s [a where true] [b where x > 0] [any where x == 2] until [c where x == 3]", {"watermark": "5 seconds"}),
    ("join by k [a where true] [any where x > 1] [c where true] until [b where x == 0]", {}),
])
def test_matches_equal_the_state_machine(spark, tmp_path, text, options):
    rows = events(2)
    q = Engine(spark, Config(ticks=1)).parse(text).base
    machine = machines.sequence if text.startswith("seq") else machines.join
    extra = {"span": Timing(1).span(q.maxspan)} if text.startswith("seq") else {}
    want = sorted(tuple(x["__ord"] for x in m) for m in machine(q, rows, **extra))
    got = sorted(tuple(json.loads(x)["__ord"] for x in r.events) for r in streamed(spark, tmp_path, rows, text, **options))
    assert got == want and want


def test_unique_and_count(spark, tmp_path):
    rows = events(3)
    (tmp_path / "u").mkdir(), (tmp_path / "c").mkdir()
    got = streamed(spark, tmp_path / "u", rows, "any where true | unique k, x")
    assert sorted((r.k.lower(), r.x) for r in got) == sorted({(e["k"].lower(), e["x"]) for e in rows})
    got = streamed(spark, tmp_path / "c", rows, "any where true | count k", "complete")
    want = {}
    for e in rows:
        want[e["k"].lower()] = want.get(e["k"].lower(), 0) + 1
    assert {r.key: r["count"] for r in got} == want


SAMPLES = Config(ticks=1, dialect=Dialect(implied_any=True, implied_base=True, allow_sample=True))


def places(matches):
    return sorted(tuple(json.loads(x)["__ord"] for x in r.events) for r in matches)


def test_samples(spark, tmp_path):
    rows, text = events(4), "sample by k [a where true] [any where x > 1] [c where x < 3]"
    want = machines.sample(Engine(spark, SAMPLES).parse(text).base, rows)
    assert places(streamed(spark, tmp_path, rows, text, config=SAMPLES)) == sorted(tuple(x["__ord"] for x in m) for m in want) and want


@pytest.mark.parametrize("text", [
    "sequence by k with maxspan=6s [a where true] [b where x > 0] [any where x == 2] until [c where x == 3]",
    "join by k [a where true] [any where x > 1] [c where true] until [b where x == 0]",
])
def test_held_events_come_in_order(spark, tmp_path, text):
    """Events that come late, but within the watermark, give what they give in order; an event far ahead ends the wait."""
    rows, r = events(5), random.Random(6)
    q = Engine(spark, Config(ticks=1)).parse(text).base
    sequence = text.startswith("seq")
    want = (machines.sequence if sequence else machines.join)(q, rows, **({"span": Timing(1).span(q.maxspan)} if sequence else {}))
    late = sorted(rows, key=lambda e: (e["__time"] + r.uniform(0, 19), e["__ord"]))
    assert late != rows
    late.append({"__ord": 10**6, "__time": 10**5, "__type": "b", "k": "r", "x": 1})
    late.append({"__ord": 10**6 + 1, "__time": 10**5, "__type": "a", "k": "r", "x": 1})
    got = places(streamed(spark, tmp_path, late, text, batches=5, watermark="20 seconds", hold=True))
    assert got == sorted(tuple(x["__ord"] for x in m) for m in want) and want


def test_pipes_after_matches(spark, tmp_path):
    rows, text = events(2), "sequence by k [a where true] [b where true]"
    found = machines.sequence(Engine(spark, Config(ticks=1)).parse(text).base, rows)
    (tmp_path / "f").mkdir(), (tmp_path / "u").mkdir()
    got = places(streamed(spark, tmp_path / "f", rows, f"{text} | filter events[1].x > 1 and events[0].k == 'P'"))
    assert got == sorted(tuple(e["__ord"] for e in m) for m in found if m[1]["x"] > 1 and m[0]["k"] in "pP") and got
    got = streamed(spark, tmp_path / "u", rows, f"{text} | unique events[1].x")
    xs = [json.loads(r.events[1])["x"] for r in got]
    assert sorted(xs) == sorted({m[1]["x"] for m in found})


KIN = "__ord long, __time long, __type string, k string, x long, pid long, ppid long, subtype string, process_name string"


def kin(seed, n=160):
    """Process and file events of two hosts, with creations, ends and boots."""
    r, out = random.Random(seed), []
    for k in range(n):
        e = {"__ord": k, "__time": k, "__type": r.choice(["process"] * 4 + ["file"]), "k": r.choice("ab"), "x": r.randint(0, 9), "pid": r.randint(0, 7), "ppid": r.randint(0, 7), "subtype": r.choice(["create", "fork", "terminate", "other"])}
        if e["pid"] == 4 and r.random() < 0.1:
            e |= {"subtype": "create", "process_name": "System"}
        out.append(e)
    return out


@pytest.mark.parametrize("kind", ["event", "child", "descendant"])
@pytest.mark.parametrize("hold", [False, True])
def test_ancestry_by_host(spark, tmp_path, kind, hold):
    rows = kin(7 if hold else 9)
    inner = Engine(spark).parse("process where x > 7").base
    want = sorted(e["__ord"] for h in "ab" for mine in [[e for e in rows if e["k"] == h]] for e, held in zip(mine, machines.related(kind, inner, mine), strict=True) if held and e["x"] < 8)
    if hold:
        rows = sorted(rows, key=lambda e: e["__time"] + random.Random(e["__ord"]).uniform(0, 25))
        rows += [{"__ord": 10**6 + k, "__time": 10**5, "__type": "file", "k": "c", "x": 9} for k in range(2)]
    options = {"watermark": "30 seconds", "hold": True} if hold else {}
    got = streamed(spark, tmp_path, rows, f"any where x < 8 and {kind} of [process where x > 7]", schema=KIN, config=Config(ticks=1, host_partition="k"), **options)
    assert sorted(r["__ord"] for r in got) == want and want
    assert set(got[0].asDict()) == {"__ord", "k", "x", "pid", "ppid", "subtype", "process_name"}


@pytest.mark.parametrize("text", [
    "any where descendant of [process where x > 3 and child of [process where x > 6]]",
    "sequence by k [process where child of [process where x > 6]] [file where true]",
    "any where child of [a where true] or event of [b where true]",
])
def test_one_relationship_a_stream(spark, text):
    df = spark.readStream.format("rate").load().selectExpr("value AS __ord", "value AS __time", "'a' AS __type", "'k' AS k", "value AS x", "value AS pid", "value AS ppid")
    with pytest.raises(CompileError):
        Engine(spark, Config(host_partition="k")).stream(text, df)


def test_held_events_need_a_watermark(spark):
    df = spark.readStream.format("rate").load().selectExpr("value AS __ord", "value AS __time", "'a' AS __type", "'k' AS k", "value AS x")
    with pytest.raises(CompileError):
        Engine(spark).stream("sequence [a where true] [b where true]", df, hold=True)
    with pytest.raises(CompileError):
        Engine(spark).stream("sequence [a where true] [b where true] | unique events[0].x", df, watermark="5 seconds")


@pytest.mark.parametrize("text", ["any where true | sort x", "any where true | tail", "any where child of [a where true]", "sequence [a where true] [b where true] | count", "any where true | count k | filter count > 1"])
def test_what_streams_cannot_do(spark, text):
    df = spark.readStream.format("rate").load().selectExpr("value AS __ord", "value AS __time", "'a' AS __type", "'k' AS k", "value AS x")
    with pytest.raises(CompileError):
        Engine(spark).stream(text, df)
