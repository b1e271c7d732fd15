"""Ancestry: `event of`, `child of`, `descendant of`, over the lives of process ids.

A pid is marked by a match (or by its creation under a marked parent), and cleared at the process
event after its termination or at a boot. What lies between two clears of a pid is a life. A life has one
number, the first place at which it is marked, and a test at a place holds if that is not later. So
descendants are an earliest arrival: a creation links the life of its parent to the life of its child at
its place, and passes a mark on if the parent's life is marked before it. Rounds look only at lives that the
round before improved, and drop the links to what is born before; few links left, or a descent of many rounds, are
swept in the order of places, which needs one pass for any depth.

Events that share a place in the order are simultaneous: each sees the matches of all of them, and a
creation does not see those of its own place. Rows with equal places are never multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions import values as v
from wakeline.operators.events import condition_of
from wakeline.operators.frames import settle
from wakeline.plans import tree as t
from wakeline.plans.compiler import Compiler
from wakeline.sources.frames import ORD, TYPE

if TYPE_CHECKING:
    import pyarrow as pa


@dataclass(frozen=True)
class Processes:
    """Where process ids are, and what creates and ends them.

    host: an expression that parts independent hosts; without it all events are one host.
    """

    pid: str = "pid"
    ppid: str = "ppid"
    opcodes: bool = False
    host: str | None = None


def _value(c: Compiler, path: str) -> v.Value:
    base, *rest = path.split(".")
    return c.value(t.Field(base, tuple(rest)))


def _text(x: v.Value) -> Column:
    return v.text_of(x).col


SHIFT = 17  # bits of the order in one window at most, so that the windows of one host are many tasks, whatever its length


def _scan(rows: DataFrame, at: str, bits: int, total: bool, own: bool = False) -> DataFrame:
    """rows(host, at, x, ..) with `run`: the least x at later places of the host, or the total of x at earlier places (with
    `own` also at its own). Windows are over stretches of 2^SHIFT places; what lies beyond comes from the stretches' own
    folds, scanned in the same way. Rows that share a place stay as they are."""
    top = bits <= SHIFT
    group = [] if top else [f"{at}_"]
    fold = F.sum if total else F.min
    x = rows if top else rows.withColumn(f"{at}_", F.shiftright(at, SHIFT))
    # looking ahead is looking back in falling order, as frames that reach ahead take a square of the time
    w = Window.partitionBy("host", *group).orderBy(F.col(at) if total else -F.col(at)).rangeBetween(Window.unboundedPreceding, 0 if own else -1)
    x = x.withColumn("run", fold("x").over(w))
    if top:
        return x
    sums = rows.groupBy("host", F.shiftright(at, SHIFT).alias(f"{at}_")).agg(fold("x").alias("x"))
    beyond = _scan(sums, f"{at}_", bits - SHIFT, total).select("host", f"{at}_", F.col("run").alias("beyond"))
    both = F.coalesce("run", F.lit(0)) + F.coalesce("beyond", F.lit(0)) if total else F.least("run", "beyond")
    return x.join(beyond, ["host", f"{at}_"]).withColumn("run", both).drop("beyond", f"{at}_")


def along(slim: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """slim with `epoch`, the boots of a host before each place and at it, and its ended rows with `next`, the place of the
    process event after each. Only what boots or ends is scanned for."""
    r = slim.agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.max("boot").alias("boots"), F.max("ended").alias("ends")).first()
    at = lambda x: x.withColumn("at", F.col("ord") - r.low)
    bits = 0 if r.low is None else (r.high - r.low).bit_length()
    if r.boots:
        x = at(slim).withColumn("x", F.col("boot").cast("bigint"))
        slim = settle(_scan(x, "at", bits, total=True, own=True).withColumnRenamed("run", "epoch").drop("at", "x"), "ancestry-epochs")
    else:
        slim = slim.withColumn("epoch", F.lit(0).cast("bigint"))
    if not r.ends:
        return slim, None
    x = at(slim.where("process").select("host", "epoch", "pid", "id", "ended", "ord")).withColumn("x", F.col("ord"))
    return slim, _scan(x, "at", bits, total=False).where("ended AND run IS NOT NULL").withColumnRenamed("run", "next")


AT_ONCE = 1 << 20  # links, 32 bytes each, that one task takes to the end; more go in rounds
ROUNDS = 16  # after these, what is left goes by stretches of places, so that no depth of descent matters


def _lives(slim: DataFrame) -> DataFrame:
    """Rows (what, id, host, pid, ord, create, hit, life): each event under its own pid (own), and each creation under its
    parent's (birth). A life is named by the first of its rows."""
    x, ended = along(slim)
    names = ["host", "epoch", "pid", "ord", "id"]
    no = F.lit(False)
    rows = x.select(F.lit(0).alias("what"), *names, "create", "hit")
    rows = rows.union(x.where("create").select(F.lit(1), "host", "epoch", "ppid", "ord", "id", no, no))
    if ended is not None:
        # the next process event is of the same epoch or a boot, which clears all anyway
        rows = rows.union(ended.select(F.lit(2), "host", "epoch", "pid", "next", "id", no, no))
    clear = F.col("what") == 2
    line = Window.partitionBy("host", "epoch", "pid").orderBy("ord", ~clear).rowsBetween(Window.unboundedPreceding, 0)
    name = F.col("id") * 3 + F.col("what")
    life = F.coalesce(F.last(F.when(clear, name), ignorenulls=True).over(line), F.first(name).over(line))
    return rows.withColumn("life", life).where(~clear).drop("epoch")


OWN, BIRTH = "what = 0", "what = 1"


def _swept(links: DataFrame, marks: DataFrame) -> DataFrame:
    """(life, t): the first marks that links(parent, child, ord) pass on, taken to the end by one task in the order of places."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        table = [b for b in batches if b.num_rows]
        known: dict[int, int] = {}  # the first mark of each life
        for b in table:
            known.update((p, t) for p, t in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True) if t is not None)
        born: dict[int, int] = {}
        for b in table:
            for parent, child, at in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                # a place is later than all marks that could reach it, so the first that comes is the least
                if known.get(parent, at) < at and child not in born:
                    born[child] = at
                    known[child] = min(at, known.get(child, at))
        yield pa.RecordBatch.from_arrays([pa.array(born.keys(), pa.int64()), pa.array(born.values(), pa.int64())], names=["life", "t"])

    x = links.join(marks.select(F.col("life").alias("parent"), "t"), "parent", "left")
    return x.select("parent", "child", "ord", "t").repartition(1).sortWithinPartitions("ord").mapInArrow(sweep, "life long, t long")


def _passed(links: DataFrame, marks: DataFrame) -> DataFrame:
    """(life, t) of the children that creations after their parents' marks(life, t) make."""
    return links.join(marks.select(F.col("life").alias("parent"), "t"), "parent").where("ord > t").groupBy(F.col("child").alias("life")).agg(F.min("ord").alias("t"))


def _marks(lives: DataFrame, kind: str) -> DataFrame:
    """(life, t): the first place at which each life is marked."""
    hits = lives.where(OWN).where("hit").groupBy("life").agg(F.min("ord").alias("t"))
    if kind == "event":
        return hits
    births = lives.where(BIRTH).select("id", F.col("life").alias("parent"), "ord")
    links = births.join(lives.where(OWN).where("create").select("id", F.col("life").alias("child")), "id").select("parent", "child", "ord")
    if kind == "child":
        return _passed(links, hits)
    links = settle(links, "ancestry-links")
    # by life: t, its first mark, of a match or of a birth; born, the first mark of a birth; fresh, whether t is of this round
    marks = settle(hits.select("life", "t", F.lit(None).cast("bigint").alias("born"), F.lit(True).alias("fresh")), "ancestry-marks")
    n = links.count()
    for _ in range(ROUNDS):
        if n <= AT_ONCE:
            break
        best = _passed(links, marks.where("fresh")).withColumnRenamed("t", "new")
        both = marks.drop("fresh").join(best, "life", "full")
        fresh = F.coalesce(F.col("new") < F.col("t"), F.col("new").isNotNull())
        marks = settle(both.select("life", F.least("t", "new").alias("t"), F.least("born", "new").alias("born"), fresh.alias("fresh")), "ancestry-marks")
        moved = marks.where("fresh").count()
        if not moved:
            return marks.where("born IS NOT NULL").select("life", F.col("born").alias("t"))
        if moved * 64 > n:
            # links whose child is born before serve no more; written anew only where these may be many
            known = marks.select(F.col("life").alias("child"), "born")
            links = settle(links.join(known, "child", "left").where("born IS NULL OR ord < born").select("parent", "child", "ord"), "ancestry-links")
            n = links.count()
    pieces = 1 if n <= AT_ONCE else -(-2 * n // AT_ONCE)
    cuts = links.approxQuantile("ord", [k / pieces for k in range(1, pieces)], 0.25 / pieces) if pieces > 1 else []
    ends = [None, *sorted({int(x) for x in cuts}), None]
    for low, high in pairwise(ends):
        part = links if low is None else links.where(F.col("ord") > low)
        late = _swept(part if high is None else part.where(F.col("ord") <= high), marks).withColumnRenamed("t", "new")
        both = marks.select("life", "t", "born").join(late, "life", "full")
        marks = settle(both.select("life", F.least("t", "new").alias("t"), F.least("born", "new").alias("born")), "ancestry-marks")
    return marks.where("born IS NOT NULL").select("life", F.col("born").alias("t"))


def facts(compiler: Compiler, relation: t.Relation, processes: Processes) -> dict[str, Column]:
    """What a relation asks of an event: host, pid, ppid (a missing id is an id of its own), and whether it is a match of
    the inner query, a creation, an end, a boot, a process event."""
    pid, ppid = _text(_value(compiler, processes.pid)), _text(_value(compiler, processes.ppid))
    is_process = F.col(TYPE) == "process"
    if processes.opcodes:
        opcode = v.as_kind(_value(compiler, "opcode"), v.NUMBER).col
        create, end = opcode.isin(1, 3, 9), opcode.isin(2, 4)
    else:
        subtype = v.as_kind(_value(compiler, "subtype"), v.STRING).col
        create, end = subtype.isin("create", "fork"), subtype == "terminate"
    no = lambda c: F.coalesce(c, F.lit(False))
    plain = v.as_kind(_value(compiler, "pid"), v.NUMBER).col
    boot = no(is_process & create & (plain == 4) & (v.as_kind(_value(compiler, "process_name"), v.STRING).col == "System"))
    able = (F.coalesce(plain, F.lit(0)) != 0) & no(v.truth(_value(compiler, processes.pid)))
    host = _text(_value(compiler, processes.host)) if processes.host else F.lit("")
    hit = no(condition_of(compiler, relation.query)) & able
    ended = no(is_process & end) & (~boot if relation.kind == "event" else F.lit(True))
    named = lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit(""))
    return {"host": F.coalesce(host, F.lit("")), "pid": named(pid), "ppid": named(ppid), "hit": hit, "create": no(is_process & create), "ended": ended, "boot": boot, "process": no(is_process)}


def mark(df: DataFrame, compiler: Compiler, relation: t.Relation, processes: Processes, name: str) -> DataFrame:
    """df with a boolean column `name`: whether the relation holds at each row."""
    asked = facts(compiler, relation, processes)
    slim = df.select(F.col(ORD).alias("ord"), F.monotonically_increasing_id().alias("id"), *[c.alias(k) for k, c in asked.items()])
    # all that follows starts from these few columns
    slim = settle(slim, "ancestry")
    lives = settle(_lives(slim), "ancestry-lives")
    marks = _marks(lives, relation.kind)
    held = lives.where(OWN).join(marks, "life").where("t <= ord").select(F.col("ord").alias("__o"), F.col("host").alias("__h"), F.col("pid").alias("__p")).distinct()
    # only what holds is joined back: where that is little, no event body is shuffled
    held = settle(held.withColumn("__held", F.lit(True)), "ancestry-held")
    out = df.withColumns({"__host": asked["host"], "__pid": asked["pid"]})
    out = out.join(held, (F.col(ORD) == F.col("__o")) & (F.col("__host") == F.col("__h")) & (F.col("__pid") == F.col("__p")), "left")
    return out.withColumn(name, F.coalesce("__held", F.lit(False))).drop("__o", "__h", "__p", "__held", "__host", "__pid")
