"""Pipes: what follows a base query. Each takes a flow and returns one; order is the column __ord."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.errors import CompileError
from wakeline.functions import values as v
from wakeline.functions.scalar import Context
from wakeline.functions.values import Value
from wakeline.plans import tree as t
from wakeline.plans.compiler import DATA, Compiler, Scope, key
from wakeline.sources.frames import META, ORD, TYPE


@dataclass(frozen=True)
class Flow:
    """Results on their way: flat event rows, or rows of events (several: a match's)."""

    df: DataFrame
    several: bool = False
    context: Context = Context()
    host: str = "hostname"
    functions: dict[str, Callable[[list[Value]], Value]] | None = None

    def compiler(self) -> Compiler:
        scope = Scope.frame(self.df)
        if self.several:
            scope = replace(scope, events=Value(F.col("events"), v.ARRAY, self.df.schema["events"].dataType))
        return Compiler(scope, self.context, {}, self.functions or {})

    def with_df(self, df: DataFrame, several: bool | None = None) -> Flow:
        return replace(self, df=df, several=self.several if several is None else several)

    def hosts(self) -> Column | None:
        """The host of a result as a string, if the data can have one."""
        base, *rest = self.host.split(".")
        x = self.compiler().value(t.Field(base, tuple(rest)))
        return None if x.kind == v.NULL else v.text_of(x).col


PIPES: dict[str, Callable[[Flow, tuple[t.Node, ...]], Flow]] = {}


def register(name: str) -> Callable[[Callable[[Flow, tuple[t.Node, ...]], Flow]], Callable[[Flow, tuple[t.Node, ...]], Flow]]:
    """Add a pipe to the language."""

    def add(f: Callable[[Flow, tuple[t.Node, ...]], Flow]) -> Callable[[Flow, tuple[t.Node, ...]], Flow]:
        PIPES[name] = f
        return f

    return add


def amount(args: tuple[t.Node, ...], name: str) -> int:
    if not args:
        return 50
    x = args[0]
    if len(args) > 1 or not isinstance(x, t.Literal) or isinstance(x.value, bool) or not isinstance(x.value, int) or x.value <= 0:
        raise CompileError(f"{name} takes one number above 0")
    return x.value


def _needed(args: tuple[t.Node, ...], name: str) -> None:
    if not args:
        raise CompileError(f"{name} needs a value")


def shown(x: Value) -> Column:
    """A key as it is shown: null becomes its kind's empty value."""
    if x.kind == v.STRING:
        return F.coalesce(x.col, F.lit(""))
    if x.kind == v.NUMBER:
        return F.coalesce(x.col, F.lit(0)) if x.digits is None else F.coalesce(x.digits, F.lit("0"))
    if x.kind == v.BOOLEAN:
        return F.coalesce(x.col, F.lit(False))
    return F.coalesce(v.text_of(x).col, F.lit(""))


def sortable(context: Context, x: Value) -> list[Column]:
    """A value as sort columns: null like the empty value; mixed values by kind, numbers as numbers."""
    if x.kind == v.STRING:
        return [context.fold(shown(x))]
    if x.kind == v.MIXED:
        return [F.coalesce(v.as_kind(x, v.NUMBER).col, F.lit(0.0)), context.fold(F.coalesce(v.as_kind(x, v.STRING).col, F.lit("")))]
    return [shown(x)] if x.digits is None else [v.rank_of(Value(shown(x), v.NUMBER, digits=shown(x)))]


@register("filter")
def filter_(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    if len(args) != 1:
        raise CompileError("filter takes one condition")
    return flow.with_df(flow.df.where(flow.compiler().condition(args[0])))


@register("head")
def head(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    return flow.with_df(flow.df.orderBy(ORD).limit(amount(args, "head")))


@register("tail")
def tail(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    return flow.with_df(flow.df.orderBy(F.desc(ORD)).limit(amount(args, "tail")).orderBy(ORD))


@register("sort")
def sort(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    """Ascending and stable. Positions are numbered anew by rank within range partitions, offset by
    the partitions before, so no task sees all rows."""
    _needed(args, "sort")
    c = flow.compiler()
    columns = [x for a in args for x in sortable(flow.context, c.value(a))]
    names = [f"__s{k}" for k in range(len(columns))]
    df = flow.df.withColumns(dict(zip(names, columns, strict=True))).orderBy(*names, ORD)
    # ids rise with the partition and within it, and orderBy has ranged the partitions
    return flow.with_df(df.withColumn(ORD, F.monotonically_increasing_id()).drop(*names))


def _keys(flow: Flow, args: tuple[t.Node, ...]) -> tuple[DataFrame, list[str]]:
    c = flow.compiler()
    names = [f"__k{k}" for k in range(len(args))]
    return flow.df.withColumns({n: key(c, a) for n, a in zip(names, args, strict=True)}), names


def first_of(df: DataFrame, names: list[str]) -> DataFrame:
    """The first row of each key. Spark cuts each task's rows to one a key before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*names).orderBy(ORD))
    return df.withColumn("__number", number).where("__number = 1").drop("__number")


@register("unique")
def unique(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    _needed(args, "unique")
    df, names = _keys(flow, args)
    return flow.with_df(first_of(df, names).drop(*names))


def share(got: DataFrame) -> Column:
    """Each row's part of all counts, by a subquery, so no task sees all keys. It names all columns,
    so that it is planned over the same exchange as the rows and nothing below is run twice."""
    every = got.agg(F.struct(F.sum("count").alias("sum"), *[F.any_value(f"`{c}`").alias(f"c{k}") for k, c in enumerate(got.columns)]).alias("s"))
    return F.col("count") / every.scalar()["sum"]


def united(sets: Column) -> Column:
    """Hosts in order; null where there is none, so that sinks leave them out."""
    return F.when(F.size(sets) > 0, F.array_sort(sets)).alias("hosts")


@register("count")
def count(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    """One row a key, with its share and hosts, by count and key; without keys one row of totals."""
    host = flow.hosts()
    df = flow.df if host is None else flow.df.withColumn("__host", host)
    hosts = [] if host is None else [united(F.collect_set("__host"))]
    total_hosts = [] if host is None else [F.size("hosts").alias("total_hosts")]
    if not args:
        got = df.agg(F.count("*").alias("count"), *hosts)
        return flow.with_df(got.select(F.lit("totals").alias("key"), "count", *(["hosts"] if hosts else []), *total_hosts, F.lit(0).cast("bigint").alias(ORD)), several=False)
    c = flow.compiler()
    values = [c.value(a) for a in args]
    names = [f"__k{k}" for k in range(len(args))]
    folded = [flow.context.fold(shown(x)) if x.kind in (v.STRING, v.MIXED, v.NULL) else shown(x) for x in values]
    df = df.withColumns(dict(zip(names, folded, strict=True)) | {f"__v{k}": shown(x) for k, x in enumerate(values)})
    # the first-seen spelling is shown
    shown_key = F.struct(ORD, *[f"__v{k}" for k in range(len(args))])
    got = df.groupBy(*names).agg(F.count("*").alias("count"), F.min(shown_key).alias("__first"), *hosts)
    got = got.withColumn("percent", share(got))
    kinds = {df.schema[f"__v{k}"].dataType.simpleString() for k in range(len(args))}
    parts = [F.col(f"__first.__v{k}") for k in range(len(args))]
    if len(args) == 1:
        label = parts[0]
    else:
        label = F.array(*parts) if len(kinds) == 1 else F.array(*(v.text_of(v.typed(p, df.schema[f"__v{k}"].dataType)).col for k, p in enumerate(parts)))
    got = got.select(label.alias("key"), "count", "percent", *(["hosts"] if hosts else []), *total_hosts).orderBy("count", "key")
    return flow.with_df(got.withColumn(ORD, F.monotonically_increasing_id()), several=False)


@register("unique_count")
def unique_count(flow: Flow, args: tuple[t.Node, ...]) -> Flow:
    """The first result of each key with count, percent and hosts; counts and hosts from before are summed up."""
    _needed(args, "unique_count")
    df, names = _keys(flow, args)
    c = flow.compiler()
    earlier = v.as_kind(c.value(t.Field("count")), v.NUMBER).col.cast("bigint")
    host, before = flow.hosts(), c.value(t.Field("hosts"))
    df = df.withColumn("__n", F.coalesce(earlier, F.lit(1).cast("bigint")))
    hosts = []
    none = F.array().cast("array<string>")
    had = F.coalesce(before.col.cast("array<string>"), none) if before.kind == v.ARRAY else none
    if host is not None or before.kind == v.ARRAY:
        own = F.lit(None).cast("string") if host is None else host
        df = df.withColumn("__host", F.when(own != "", F.array(own)).otherwise(had))
        hosts = [united(F.array_distinct(F.flatten(F.collect_set("__host"))))]
    new = ["count", "percent", *(["hosts", "total_hosts"] if hosts else [])]
    kept = [c for c in flow.df.columns if c not in new and not (hosts and not flow.several and c == flow.host)]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in kept]), ORD)
    got = df.groupBy(*names).agg(first.alias("__first"), F.sum("__n").alias("count"), *hosts)
    got = got.withColumn("percent", share(got))
    if hosts:
        got = got.withColumn("total_hosts", F.size("hosts"))
    return flow.with_df(got.select("__first.*", *new))


def merge(partials: DataFrame, pipe: t.Pipe) -> DataFrame:
    """Rows of `count` from several engines as one: counts summed, hosts united, shares anew."""
    has = "hosts" in partials.columns
    hosts = [united(F.array_distinct(F.flatten(F.collect_set("hosts"))))] if has else []
    if not pipe.args:
        got = partials.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"), *hosts).withColumn("key", F.lit("totals"))
        names = ["key", "count"]
    else:
        texts = isinstance(partials.schema["key"].dataType, T.StringType)
        folded = F.lower("key") if texts else F.col("key")
        got = partials.groupBy(folded.alias("__k")).agg(F.sum("count").alias("count"), F.first("key").alias("key"), *hosts)
        got = got.withColumn("percent", share(got))
        names = ["key", "count", "percent"]
    if has:
        got = got.withColumn("total_hosts", F.size("hosts"))
        names += ["hosts", "total_hosts"]
    return got.select(*names).orderBy("count", "key")


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META and c not in (TYPE, DATA) and not c.startswith("__")]
