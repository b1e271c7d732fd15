"""Sequences, joins and samples of events.

sequence: one shuffle by key and one sort; each further step is a window function over the same
partitioning that carries the pending partial match forward. join: an ordered fold for each key,
streamed over sorted partitions. sample: numbered matches cut in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.operators.events import condition_of, step_key
from wakeline.operators.frames import body_hash
from wakeline.plans import tree as t
from wakeline.plans.compiler import Compiler
from wakeline.sources.frames import ORD, TIME, TYPE


@dataclass(frozen=True)
class Timing:
    """Ticks of a second; spans are cut to whole seconds unless exact."""

    ticks: int = 10_000_000
    exact: bool = False

    def span(self, s: t.Span | None) -> int | None:
        if s is None:
            return None
        return round(s.seconds * self.ticks) if self.exact else int(s.seconds) * self.ticks


CLOSE = -1


def _rows(df: DataFrame, compiler: Compiler, steps: tuple[t.Step, ...], until: t.Step | None, reverse: bool) -> tuple[DataFrame, list[str]]:
    """A row for each event and step that it takes part in: keys k0.., ord, rank, pos, hit, event.

    The frame is read once; events that no step wants go before the shuffle.
    """
    n = len(steps)
    event = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    parts: list[Column] = []
    wanted: list[Column] = []
    keys = max(len(s.by) for s in steps)
    names = [f"k{i}" for i in range(keys)]
    every = [(k, s) for k, s in enumerate(steps)] + ([(CLOSE, until)] if until else [])
    columns = [[step_key(compiler, s.by[i]) for _, s in every] for i in range(keys)]
    types = [{df.select(c).schema[0].dataType.simpleString() for c in cs} for cs in columns]
    for at, (pos, s) in enumerate(every):
        hit = F.coalesce(condition_of(compiler, s.query), F.lit(False))
        want = hit
        if s.missing:
            want = F.lit(True) if s.query.event == "any" else F.col(TYPE) == s.query.event
        rank = CLOSE if pos == CLOSE else n - 1 - pos if reverse else pos
        key = [columns[i][at].cast("string" if len(types[i]) > 1 else next(iter(types[i]))).alias(names[i]) for i in range(keys)]
        wanted.append(want)
        parts.append(F.when(want, F.struct(F.lit(rank).alias("rank"), F.lit(pos).alias("pos"), hit.alias("hit"), *key)))
    x = df.where(reduce(or_, wanted))
    x = x.select(event.alias("event"), F.col(ORD).alias("ord"), F.col(TIME).alias("time"), F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
    return x.select("event", "ord", "time", "p.*"), names


def sequence(df: DataFrame, compiler: Compiler, q: t.Sequence, timing: Timing) -> DataFrame:
    """Matches (events, __ord of the last), one pending partial a step and key.

    For step p the pending partial is the last of: an arrival from step p - 1, a taking by step p
    (unless it forks), a close. Steps of one event are ranked last step first, so it advances a
    sequence once. Times are taken not to fall in arrival order.
    """
    rows, names = _rows(df, compiler, q.steps, q.until, reverse=True)
    span = timing.span(q.maxspan)
    w = Window.partitionBy(*names).orderBy("ord", "rank").rowsBetween(Window.unboundedPreceding, -1)
    one = F.array("event")
    none = F.array().cast(rows.select(one.alias("a")).schema[0].dataType)
    started = F.struct(F.struct(*([none.alias("seq"), F.lit(None).cast("bigint").alias("since")] if q.steps[0].missing else [one.alias("seq"), F.col("time").alias("since")])).alias("v"))
    ok = ~F.col("hit") if q.steps[0].missing else F.col("hit")
    rows = rows.withColumn("s0", F.when((F.col("pos") == 0) & ok, started))
    for p in range(1, len(q.steps)):
        step = q.steps[p]
        empty = F.struct(F.lit(None).cast(rows.select(F.col("s0.v").alias("v")).schema[0].dataType).alias("v"))
        pending = F.when((F.col("pos") == p - 1) & F.col(f"s{p - 1}").isNotNull(), F.col(f"s{p - 1}")).when(F.col("pos") == CLOSE, empty)
        if not (step.fork and not step.missing):
            pending = pending.when(F.col("pos") == p, empty)
        rows = rows.withColumn("prev", F.last(pending, ignorenulls=True).over(w))
        v = F.col("prev.v")
        live = (F.col("pos") == p) & v.isNotNull() & (~F.col("hit") if step.missing else F.col("hit"))
        if span is not None:
            live &= F.coalesce(v["since"] >= F.col("time") - span, F.lit(True))
        grown = v if step.missing else F.struct(F.concat(v["seq"], one).alias("seq"), F.coalesce(v["since"], F.col("time")).alias("since"))
        rows = rows.withColumn(f"s{p}", F.when(live, F.struct(grown.alias("v"))))
    last = len(q.steps) - 1
    found = rows.where((F.col("pos") == last) & F.col(f"s{last}").isNotNull())
    return found.select(F.col(f"s{last}.v.seq").alias("events"), F.col("ord").alias(ORD))


def join(df: DataFrame, compiler: Compiler, q: t.Join) -> DataFrame:
    """Matches of one event for each slot: the first that comes, in slot order, then the key starts anew.

    Whether a slot is free depends on all that came before, so a key's rows are folded in order. Rows
    (key, ord, hash, slot) without event bodies are dealt by key, sorted, and streamed; a key's state is
    one arrival for each slot, whatever the key's size. Bodies are then joined to the arrivals that matches hold,
    by place and hash: events that share a place are told apart, and copies of one event there are one arrival's body.
    Only events that some slot wants are read for it; where matches are few, they are sent to the events.
    """
    rows, names = _rows(df, compiler, q.steps, q.until, reverse=False)
    n = len(q.steps)
    slim = rows.select(F.xxhash64(*names, F.lit(0)).alias("h"), F.to_json(F.struct(F.lit(0).alias("z"), *names), {"ignoreNullFields": "false"}).alias("key"), "ord", _tie(df, "event").alias("tie"), "rank", "pos")
    dealt = slim.repartition("h").sortWithinPartitions("h", "key", "ord", "tie", "rank")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: str | None = None
        slots: list[tuple[int, int] | None] = [None] * n
        number = 0  # of a key's matches
        for b in batches:
            done, place, held, ties = [], [], [], []
            for key, at, tie, pos in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                if key != now:
                    now, slots, number = key, [None] * n, 0
                if pos == CLOSE:
                    slots = [None] * n
                elif slots[pos] is None:
                    slots[pos] = at, tie
                    if None not in slots:
                        done += [f"{at}|{number}|{key}"] * n
                        place += range(n)
                        held += [x[0] for x in slots]  # type: ignore[index]
                        ties += [x[1] for x in slots]  # type: ignore[index]
                        slots, number = [None] * n, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(place, pa.int32()), pa.array(held, pa.int64()), pa.array(ties, pa.int64())], names=["match", "place", "held", "held_tie"])

    matches = dealt.mapInArrow(fold, "match string, place int, held long, held_tie long")
    event = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    wanted = reduce(or_, [F.coalesce(condition_of(compiler, s.query), F.lit(False)) for s in q.steps])
    bodies = df.where(wanted).select(F.col(ORD).alias("o"), event.alias("event")).withColumn("tie", _tie(df, "event"))
    both = matches.join(bodies, (matches.held == bodies.o) & (matches.held_tie == bodies.tie))
    got = both.groupBy("match").agg(*[F.any_value(F.when(F.col("place") == k, F.col("event")), ignoreNulls=True).alias(f"e{k}") for k in range(n)])
    done = F.split_part("match", F.lit("|"), F.lit(1)).cast("bigint")
    return got.select(F.array(*[F.col(f"e{k}") for k in range(n)]).alias("events"), done.alias(ORD))


def _tie(df: DataFrame, event: str) -> Column:
    """What tells apart events of one place: nothing where places are known to be unique, else a hash of the event."""
    return F.lit(0).cast("bigint") if df.schema[ORD].metadata.get("unique") else body_hash(df, event)


def sample(df: DataFrame, compiler: Compiler, q: t.Sample) -> DataFrame:
    """Chunks of N matches of a key, in order; which subquery matched does not matter."""
    rows, names = _rows(df, compiler, q.steps, None, reverse=True)
    n = len(q.steps)
    number = F.row_number().over(Window.partitionBy(*names).orderBy("ord", "rank"))
    rows = rows.withColumn("number", number).withColumn("chunk", F.floor((F.col("number") - 1) / n))
    got = rows.groupBy(*names, "chunk").agg(F.array_sort(F.collect_list(F.struct("number", "ord", "event")), lambda a, b: a["number"] - b["number"]).alias("x"), F.max("ord").alias(ORD)).where(F.size("x") == n)
    return got.select(F.transform("x", lambda e: e["event"]).alias("events"), ORD)
