"""The engine: text in, DataFrame out."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.errors import CompileError
from wakeline.functions import values as v
from wakeline.functions.scalar import Context
from wakeline.functions.values import Value
from wakeline.operators import events, lineage, patterns, pipes
from wakeline.plans import parser
from wakeline.plans import tree as t
from wakeline.plans.compiler import DATA, Compiler, Scope
from wakeline.plans.macros import Definitions
from wakeline.plans.parser import Dialect
from wakeline.plans.schema import Checker, Schema
from wakeline.plans.simplify import simplify
from wakeline.sources import frames
from wakeline.sources.frames import META, ORD


@dataclass(frozen=True)
class Config:
    """host_key, pid_key, ppid_key: paths of fields. ticks: of a second. data_source: the name of a source whose opcodes
    tell creations and ends of processes. host_partition: a field that parts hosts in ancestry."""

    case_sensitive: bool = False
    ticks: int = 10_000_000
    exact_maxspan: bool = False
    host_key: str = "hostname"
    pid_key: str = "pid"
    ppid_key: str = "ppid"
    host_partition: str | None = None
    data_source: str | None = None
    flatten: bool = False
    schema: Schema = field(default_factory=Schema)
    dialect: Dialect = Dialect(implied_any=True, implied_base=True)


@dataclass(frozen=True)
class Analytic:
    """A query with its metadata; id names it in results."""

    id: str
    query: str
    metadata: Mapping[str, Any] = field(default_factory=dict)


def load_file(path: str) -> Any:
    """A configuration or analytics file: TOML or JSON by its ending."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".toml"):
        return tomllib.loads(text)
    if path.endswith((".yml", ".yaml")):
        import yaml  # optional: not every installation has it

        return yaml.safe_load(text)
    return json.loads(text)


def load_analytics(path: str) -> list[Analytic]:
    """Analytics of a file: {"analytics": [{"query", "metadata": {"id", ..}}]} or one such entry."""
    data = load_file(path)
    found = data.get("analytics", [data]) if isinstance(data, dict) else data
    return [Analytic(str(x.get("metadata", {}).get("id", k)), x["query"], x.get("metadata", {})) for k, x in enumerate(found)]


def save_analytics(analytics: Iterable[Analytic], path: str) -> None:
    data = {"analytics": [{"query": a.query, "metadata": {"id": a.id, **a.metadata}} for a in analytics]}
    if path.endswith(".toml"):
        lines = []
        for a in data["analytics"]:
            lines += ["[[analytics]]", f"query = {json.dumps(a['query'])}", "[analytics.metadata]", *(f"{json.dumps(k)} = {json.dumps(x)}" for k, x in a["metadata"].items()), ""]
        Path(path).write_text("\n".join(lines), encoding="utf-8")
    elif path.endswith((".yml", ".yaml")):
        import yaml

        Path(path).write_text(yaml.safe_dump(data), encoding="utf-8")
    else:
        Path(path).write_text(json.dumps(data, indent=2, sort_keys=True), encoding="utf-8")


class Engine:
    """Queries over one frame of events, or over frames given with each query."""

    def __init__(self, spark: SparkSession, config: Config = Config(), frame: DataFrame | None = None) -> None:
        self.spark, self.config, self.frame = spark, config, frame
        self.definitions = Definitions()
        self.functions: dict[str, Callable[[list[Value]], Value]] = {}

    # setting up

    def load(self, source: DataFrame | str | Iterable[Mapping[str, Any]], **roles: Any) -> Engine:
        """Take a DataFrame (type=, time=, order= name columns or expressions), a path, or events in memory."""
        if isinstance(source, DataFrame):
            self.frame = frames.from_table(source, **roles)
        elif isinstance(source, str):
            self.frame = frames.read(self.spark, source, **roles)
        else:
            self.frame = frames.from_events(self.spark, source)
        return self

    def parse_expression(self, text: str) -> t.Node:
        """An expression alone: expanded and simplified, not checked against a schema."""
        x = self.definitions.expand(parser.expression(text, self.config.dialect))
        return simplify(x, self.context) if self.config.dialect.optimize else x

    def define(self, text: str) -> Engine:
        """Add macros and constants."""
        self.definitions.add(parser.definitions(text, self.config.dialect))
        return self

    def macro(self, name: str, f: Callable[[list[t.Node]], t.Node]) -> Engine:
        """Add a macro written in Python."""
        self.definitions.custom[name] = f
        return self

    def register(self, name: str, f: Callable[..., Any], returns: str = v.STRING) -> Engine:
        """Add a function of Columns; plain Python goes through register_python()."""

        def build(args: list[Value]) -> Value:
            return Value(f(*(a.col for a in args)), returns)

        self.functions[name] = build
        return self

    def register_python(self, name: str, f: Callable[..., Any], returns: str = v.STRING) -> Engine:
        """Add a plain Python function of values; it is not called where an argument is null. Mixed values
        and objects come as what their JSON holds."""
        kinds = {v.STRING: "string", v.NUMBER: "double", v.BOOLEAN: "boolean"}

        def build(args: list[Value]) -> Value:
            ready = [a.kind in (v.STRING, v.NUMBER, v.BOOLEAN, v.ARRAY) for a in args]

            def safe(*given: Any) -> Any:
                values = [x if x is None or plain else json.loads(x) for x, plain in zip(given, ready, strict=True)]
                return None if any(x is None for x in values) else f(*values)

            columns = [a.col if plain else F.lit(None).cast("string") if a.kind == v.NULL else F.to_json(a.col) for a, plain in zip(args, ready, strict=True)]
            return Value(F.udf(safe, kinds[returns], useArrow=True)(*columns), returns)

        self.functions[name] = build
        return self

    # from text to plan

    def parse(self, text: str, check: bool = True) -> t.Query:
        """The query of a text: expanded, checked against the schema, simplified."""
        found, q = parser.query(text, self.config.dialect)
        names = self.definitions.copy()
        names.add(found)
        q = names.expand(q)  # type: ignore[assignment]
        if check:
            Checker(text, self.config.schema, self.config.dialect, custom=frozenset(self.functions)).query(q)
        if self.config.dialect.optimize:
            q = simplify(q, self.context)  # type: ignore[assignment]
        return q

    @property
    def context(self) -> Context:
        return Context(self.config.case_sensitive)

    @property
    def processes(self) -> lineage.Processes:
        c = self.config
        return lineage.Processes(c.pid_key, c.ppid_key, c.data_source is not None, c.host_partition)

    def _relations(self, df: DataFrame, q: t.Node) -> tuple[DataFrame, dict[t.Relation, Column]]:
        """df with a column for each relationship test of the query, inner ones first."""
        found: dict[t.Relation, Column] = {}
        nodes = [x for x in t.walk(q) if isinstance(x, t.Relation)]
        for x in reversed(nodes):
            if x in found:
                continue
            name = f"__relation{len(found)}"
            compiler = Compiler(Scope.frame(df), self.context, dict(found), self.functions)
            df = lineage.mark(df, compiler, x, self.processes, name)
            found[x] = F.col(name)
        return df, found

    def plan(self, q: t.Query, df: DataFrame) -> DataFrame:
        """Results with __ord, their order; matches of several events are arrays `events`."""
        df, relations = self._relations(df, q.base)
        compiler = Compiler(Scope.frame(df), self.context, relations, self.functions)
        extra = [c for c in df.columns if c.startswith("__relation")]
        timing = patterns.Timing(self.config.ticks, self.config.exact_maxspan)
        base, several = q.base, True
        if isinstance(base, (t.Sequence, t.Sample)) and len(base.steps) == 1:
            base = base.steps[0].query
        if isinstance(base, t.EventQuery):
            got, several = events.event(df, compiler, base).drop(*extra), False
        elif isinstance(base, t.Sequence):
            got = patterns.sequence(df, compiler, base, timing)
        elif isinstance(base, t.Join):
            got = patterns.join(df, compiler, base)
        elif isinstance(base, t.Sample):
            got = patterns.sample(df, compiler, base)
        else:
            raise CompileError(f"{type(base).__name__} is no query")
        flow = pipes.Flow(got, several, self.context, self.config.host_key, self.functions)
        for p in q.pipes:
            if p.name not in pipes.PIPES:
                raise CompileError(f"unknown pipe {p.name}")
            flow = pipes.PIPES[p.name](flow, p.args)
        return flow.df

    # running

    def run(self, text: str, df: DataFrame | None = None, ordered: bool = False) -> DataFrame:
        """Results of a query. ordered: sort by the results' order (else Spark decides)."""
        got = self.raw(text, df)
        if self.config.flatten:
            from wakeline.sources.sinks import flatten

            got = flatten(got)
            order = [c for c in ("__match", "__pos") if c in got.columns] or [ORD]
        else:
            order = [ORD]
        if ordered:
            got = got.orderBy(*order)
        return got.drop(*(c for c in META if c in got.columns), "__match", "__pos")

    query = run

    def raw(self, text: str, df: DataFrame | None = None) -> DataFrame:
        frame = self.frame if df is None else df
        if frame is None:
            raise CompileError("no events were loaded")
        return self.plan(self.parse(text), frame)

    def explain(self, text: str, df: DataFrame | None = None, mode: str = "formatted") -> None:
        self.raw(text, df).explain(mode)

    def analytics(self, analytics: Iterable[Analytic], df: DataFrame | None = None) -> DataFrame:
        """Results of several analytics: analytic_id, events. The frame is read by each plan; persist it
        first if it is expensive to make."""
        out: DataFrame | None = None
        for a in analytics:
            got = self.raw(a.query, df)
            if "events" not in got.columns:
                body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in got.columns if c not in META]) if DATA not in got.columns else F.col(DATA))
                one = F.array(body)
            else:
                one = F.transform("events", lambda e: F.to_json(e[DATA] if DATA in got.schema["events"].dataType.elementType.fieldNames() else e))  # type: ignore[attr-defined]
            part = got.select(F.lit(a.id).alias("analytic_id"), one.alias("events"), F.col(ORD))
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise CompileError("no analytics were given")
        return out.drop(ORD)

    def merge(self, partials: DataFrame, text: str) -> DataFrame:
        """Partial results of the same query over parts of the data (hosts), as one. Pipes up to the last count
        ran on the parts; counts are merged and the pipes after it run again; without a count all pipes run again."""
        q = self.parse(text)
        at = max([k for k, p in enumerate(q.pipes) if p.name in ("count", "unique_count")], default=-1)
        several = "events" in partials.columns
        x = partials if ORD in partials.columns else partials.withColumn(ORD, F.monotonically_increasing_id())
        flow = pipes.Flow(x, several, self.context, self.config.host_key, self.functions)
        rest = q.pipes
        if at >= 0:
            p = q.pipes[at]
            rest = q.pipes[at + 1 :]
            if p.name == "count":
                merged = pipes.merge(partials, p)
                flow = flow.with_df(merged.withColumn(ORD, F.monotonically_increasing_id()), several=False)
            else:
                flow = pipes.PIPES["unique_count"](flow, p.args)
        for p in rest:
            flow = pipes.PIPES[p.name](flow, p.args)
        return flow.df.drop(*(c for c in META if c in flow.df.columns))

    def post_process(self, results: DataFrame, text: str, several: bool | None = None) -> DataFrame:
        """The pipes of a query, run on results at hand (rows of raw() or of other engines). several: whether
        the pipes see all events of a match or, if false, only its first; by default what results hold."""
        q = self.parse(text)
        x = results if ORD in results.columns else results.withColumn(ORD, F.monotonically_increasing_id())
        many = "events" in x.columns
        if many and several is False:
            x, many = x.select("*", F.col("events")[0].alias("__first")).select(ORD, "__first.*"), False
        flow = pipes.Flow(x, many, self.context, self.config.host_key, self.functions)
        for p in q.pipes:
            flow = pipes.PIPES[p.name](flow, p.args)
        return flow.df.drop(*(c for c in META if c in flow.df.columns))

    def stream(self, text: str, df: DataFrame, **options: Any) -> DataFrame:
        """The query over a streaming frame; see wakeline.streaming.streams."""
        from wakeline.streaming import streams

        return streams.stream(self, text, df, **options)

    def with_config(self, **changes: Any) -> Engine:
        out = Engine(self.spark, replace(self.config, **changes), self.frame)
        out.definitions, out.functions = self.definitions, self.functions
        return out
