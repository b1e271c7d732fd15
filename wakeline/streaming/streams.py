"""Queries over streaming frames.

Event queries and filters pass through. `unique` keeps first arrivals (within the watermark if one
is given); `count` is a running aggregate (complete or update mode). Sequences, joins and samples keep pending
matches by key in Spark's state store, and state that a maxspan has outlived is dropped by event time. Events of a
micro-batch are applied in (time, order); if `hold` is set, events wait in the state until the watermark has passed
them, so matches are those of the whole stream in order, however it is cut into micro-batches. `filter` and `unique`
may follow matches. Ancestry keeps what is marked for each host (`host_partition` must be set); an event query may
ask for one relationship, as Spark allows one such state in a stream. An id is kept until its process ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wakeline.errors import CompileError
from wakeline.operators import events, lineage, patterns, pipes
from wakeline.plans import tree as t
from wakeline.plans.compiler import Compiler, Scope
from wakeline.sources.frames import META, ORD

RELATION = "__relation"
RESULT = "key string, events array<string>, __ord long, __time long"


class Machine:
    """The pending matches of one key, as the language defines them. pending[p] waits for step p."""

    def __init__(self, steps: list[dict[str, Any]], span: int | None, kind: str, state: Any = None) -> None:
        self.steps, self.span, self.kind = steps, span, kind
        self.pending: list[Any] = state or [None] * len(steps)

    def close(self) -> None:
        self.pending = [None] * len(self.steps)

    def row(self, pos: int, hit: bool, time: int, body: str) -> list[str] | None:
        """Apply one (event, step); the events of a match if it completes one."""
        if pos < 0:
            self.close()
            return None
        if self.kind == "sample":
            self.pending = [p for p in self.pending if p is not None] + [[time, [body]]]
            if len(self.pending) < len(self.steps):
                return None
            out = [p[1][0] for p in self.pending]
            self.close()
            return out
        if self.kind == "join":
            if self.pending[pos] is None:
                self.pending[pos] = [time, [body]]
            if None in self.pending:
                return None
            out = [p[1][0] for p in self.pending]
            self.close()
            return out
        step = self.steps[pos]
        if pos == 0:
            if hit == step["missing"]:
                return None
            new: Any = [None, []] if step["missing"] else [time, [body]]
        else:
            held = self.pending[pos]
            if held is not None and self.span is not None and held[0] is not None and held[0] < time - self.span:
                held = self.pending[pos] = None
            if held is None:
                return None
            if not step["fork"] or step["missing"]:
                self.pending[pos] = None
            if hit == step["missing"]:
                return None
            new = held if step["missing"] else [time if held[0] is None else held[0], [*held[1], body]]
        if pos + 1 == len(self.steps):
            return new[1]
        self.pending[pos + 1] = new
        return None


class Family:
    """The marked process ids of one host, by one relationship; events of one place are simultaneous."""

    def __init__(self, kind: str, state: Any = None) -> None:
        self.kind = kind
        self.matched, self.born, self.dying = (set(x) for x in state or ([], [], []))

    def place(self, rows: list[dict[str, Any]]) -> list[bool]:
        """Apply the events of a place; whether the relationship holds at each."""
        if any(r["process"] for r in rows):
            self.matched -= self.dying
            self.born -= self.dying
            self.dying = set()
        if any(r["boot"] for r in rows):
            self.matched, self.born = set(), set()
        parents = self.matched | self.born if self.kind == "descendant" else self.matched
        if self.kind != "event":
            self.born |= {r["pid"] for r in rows if r["create"] and r["ppid"] in parents}
        self.matched |= {r["pid"] for r in rows if r["hit"]}
        self.dying |= {r["pid"] for r in rows if r["ended"]}
        return [r["pid"] in (self.matched if self.kind == "event" else self.born) for r in rows]

    def state(self) -> list[list[str]]:
        return [sorted(self.matched), sorted(self.born), sorted(self.dying)]


def _stamped(df: DataFrame, watermark: str, ticks: int) -> DataFrame:
    """df(time, ..) with the time as a watermarked column ts."""
    return df.withColumn("ts", F.timestamp_micros((F.col("time") * F.lit(1_000_000) / F.lit(ticks)).cast("bigint"))).withWatermark("ts", watermark)


def _ms(time: int, ticks: int) -> int:
    """The first millisecond at or after a time; a watermark there has passed it."""
    return -(-(time * 1_000_000 // ticks) // 1000)


#: Bodies keep microseconds, so that events read back from them are what they were.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _marked(engine: Any, df: DataFrame, compiler: Compiler, relation: t.Relation, name: str, watermark: str | None) -> DataFrame:
    """df with a boolean column `name`. watermark: hold events until it has passed them."""
    asked, ticks, kind = lineage.facts(compiler, relation, engine.processes), engine.config.ticks, relation.kind
    flags = [k for k in asked if k != "host"]
    x = df.select(F.col("__time").alias("time"), F.col(ORD).alias("ord"), *[c.alias(k) for k, c in asked.items()], F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON).alias("body"))
    if watermark:
        x = _stamped(x, watermark, ticks)

    def apply(group: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        if not state.hasTimedOut:
            for part in batches:
                waiting.extend(map(list, zip(*[part[c].tolist() for c in ("time", "ord", *flags, "body")], strict=True)))
        waiting.sort(key=lambda r: r[:2])
        passed = state.getCurrentWatermarkMs() if watermark else 0
        ready = next((k for k, r in enumerate(waiting) if _ms(r[0], ticks) > passed), len(waiting)) if watermark else len(waiting)
        family, out = Family(kind, kept), []
        for _, rows in groupby(waiting[:ready], key=lambda r: r[1]):
            place = list(rows)
            found = family.place([dict(zip(flags, r[2:-1], strict=True)) for r in place])
            out += [(r[-1], x) for r, x in zip(place, found, strict=True)]
        waiting = waiting[ready:]
        state.update((json.dumps([family.state(), waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(_ms(waiting[0][0], ticks) - 1, passed + 1))
        if out:
            yield pd.DataFrame(out, columns=["body", "held"])

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    got = x.groupBy("host").applyInPandasWithState(apply, "body string, held boolean", "marks string", "append", timeout)
    return got.select(F.from_json("body", df.schema).alias("e"), F.col("held").alias(name)).select("e.*", name)


def _relation(engine: Any, df: DataFrame, q: t.Query, watermark: str | None) -> tuple[DataFrame, dict[t.Relation, Any]]:
    """df with a column for the relationship test of the query, if it has one."""
    found = list(dict.fromkeys(x for x in t.walk(q) if isinstance(x, t.Relation)))
    if not found:
        return df, {}
    if engine.config.host_partition is None:
        raise CompileError("relationships on streams need host_partition: what they keep is kept by host")
    if len(found) > 1 or not isinstance(q.base, t.EventQuery):
        raise CompileError("Spark keeps one such state a stream: one relationship, in an event query; write its results and stream them on")
    if watermark and any(p.name != "filter" for p in q.pipes):
        raise CompileError("only filters may follow events that were held")
    compiler = Compiler(Scope.frame(df), engine.context, {}, engine.functions)
    return _marked(engine, df, compiler, found[0], RELATION, watermark), {found[0]: F.col(RELATION)}


def _matches(engine: Any, df: DataFrame, q: t.Sequence | t.Join | t.Sample, compiler: Compiler, watermark: str | None, hold: bool) -> DataFrame:
    """RESULT rows. Held events are ready once no earlier one can come: Spark drops what the watermark has passed."""
    sequence = isinstance(q, t.Sequence)
    kind = "sequence" if sequence else "join" if isinstance(q, t.Join) else "sample"
    until = None if isinstance(q, t.Sample) else q.until
    rows, names = patterns._rows(df, compiler, q.steps, until, reverse=kind != "join")
    span = patterns.Timing(engine.config.ticks, engine.config.exact_maxspan).span(q.maxspan) if isinstance(q, t.Sequence) else None
    steps = [{"fork": s.fork, "missing": s.missing} for s in q.steps]
    ticks = engine.config.ticks
    key = F.to_json(F.struct(F.lit(0).alias("z"), *names), {"ignoreNullFields": "false"}).alias("key")
    body = F.to_json("event", JSON).alias("body")
    x = rows.select(key, "ord", "time", "rank", "pos", "hit", body)
    if watermark:
        x = _stamped(x, watermark, ticks)
    timed = bool(watermark) and (hold or span is not None)

    def apply(group: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, waiting, last = json.loads(state.get[0]) if state.exists else (None, [], 0)
        if not state.hasTimedOut:
            for part in batches:
                columns = [part[c].tolist() for c in ("time", "ord", "rank", "pos", "hit", "body")]
                waiting.extend(map(list, zip(*columns, strict=True)))
        waiting.sort(key=lambda r: r[:3])
        passed = state.getCurrentWatermarkMs() if timed else 0
        ready = next((k for k, r in enumerate(waiting) if _ms(r[0], ticks) > passed), len(waiting)) if hold else len(waiting)
        machine, out = Machine(steps, span, kind, pending), []
        for time, place, _, pos, hit, event in waiting[:ready]:
            found = machine.row(pos, bool(hit), time, event)
            last = max(last, time)
            if found is not None:
                out.append((group[0], found, place, time))
        waiting = waiting[ready:]
        pending = machine.pending
        if state.hasTimedOut and span is not None and _ms(last + span, ticks) < passed:
            pending = []  # outlived
        if waiting or any(p is not None for p in pending):
            state.update((json.dumps([pending or None, waiting, last]),))
            if waiting:
                state.setTimeoutTimestamp(max(_ms(waiting[0][0], ticks) - 1, passed + 1))
            elif timed and span is not None:
                state.setTimeoutTimestamp(max(_ms(last + span, ticks) + 1, passed + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "events", "__ord", "__time"])

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return x.groupBy("key").applyInPandasWithState(apply, RESULT, "pending string", "append", timeout)


def _piped(engine: Any, df: DataFrame, matches: DataFrame, steps: tuple[t.Pipe, ...], watermark: str | None) -> DataFrame:
    """Matches that pipes let through; the pipes see events with the frame's own types."""
    x = matches.withColumn("bodies", F.col("events")).withColumn("events", F.transform("bodies", lambda b: F.from_json(b, df.schema)))
    for p in steps:
        flow = pipes.Flow(x, True, engine.context, engine.config.host_key, engine.functions)
        if p.name == "filter":
            x = pipes.filter_(flow, p.args).df
        elif p.name == "unique":
            if watermark:
                raise CompileError("unique after a match keeps state of its own, which Spark does not chain to matches with a watermark; use foreachBatch")
            keyed, names = pipes._keys(flow, p.args)
            x = keyed.dropDuplicates(names).drop(*names)
        else:
            raise CompileError(f"{p.name} after a match is not supported on streams; use foreachBatch")
    return x.select("key", F.col("bodies").alias("events"), "__ord", "__time")


def stream(engine: Any, text: str, df: DataFrame, watermark: str | None = None, hold: bool = False) -> DataFrame:
    """The streaming result of a query over a streaming frame; write it with writeStream.

    watermark: how late events may come ("10 minutes"); bounds the state of unique and of
    sequences with a maxspan. Matches of several events come as (key, events as JSON, __ord, __time).
    hold: apply an event to matches only when the watermark has passed it, in (time, order) over all micro-batches; what
    the watermark has not passed when a stream is stopped waits in the checkpoint.
    """
    if hold and not watermark:
        raise CompileError("events are held for a watermark; none is given")
    q = engine.parse(text)
    base = q.base
    df, relations = _relation(engine, df, q, watermark if hold else None)
    compiler = Compiler(Scope.frame(df), engine.context, relations, engine.functions)
    if isinstance(base, t.EventQuery):
        got = events.event(df, compiler, base).drop(RELATION)
    elif isinstance(base, (t.Sequence, t.Join, t.Sample)):
        got = _matches(engine, df, base, compiler, watermark, hold)
        return _piped(engine, df, got, q.pipes, watermark) if q.pipes else got
    else:
        raise CompileError(f"{type(base).__name__} is no query of streams")
    for p in q.pipes:
        flow = pipes.Flow(got, False, engine.context, engine.config.host_key, engine.functions)
        if p.name == "filter":
            got = pipes.filter_(flow, p.args).df
        elif p.name == "unique":
            keyed, names = pipes._keys(flow, p.args)
            if watermark:
                ts = F.timestamp_micros((F.col("__time") * F.lit(1_000_000) / F.lit(engine.config.ticks)).cast("bigint"))
                keyed = keyed.withColumn("__ts", ts).withWatermark("__ts", watermark).dropDuplicatesWithinWatermark(names).drop("__ts")
            else:
                keyed = keyed.dropDuplicates(names)
            got = keyed.drop(*names)
        elif p.name == "count":
            if not p.args:
                got = got.agg(F.count("*").alias("count")).withColumn("key", F.lit("totals"))
            else:
                keyed, names = pipes._keys(flow, p.args)
                got = keyed.groupBy(*names).agg(F.count("*").alias("count")).withColumnsRenamed({n: f"key{k}" if len(names) > 1 else "key" for k, n in enumerate(names)})
            if p is not q.pipes[-1]:
                raise CompileError("a count ends a streaming query")
        else:
            raise CompileError(f"{p.name} has no meaning on an endless stream")
    return got.drop(*(c for c in META if c in got.columns and c != ORD))
