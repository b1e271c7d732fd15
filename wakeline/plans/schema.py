"""Optional schemas of event types, and the static check of a query against one."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.errors import CompileError, ParseError, SchemaFault, SemanticFault, TypeFault
from wakeline.functions import scalar
from wakeline.functions.values import ARRAY, BOOLEAN, MIXED, NULL, NUMBER, OBJECT, STRING
from wakeline.plans import tree as t
from wakeline.plans.parser import Dialect

GENERIC, ANY = "generic", "any"


def _valid(x: Any) -> bool:
    if isinstance(x, str):
        return x in (STRING, NUMBER, BOOLEAN, MIXED, OBJECT, ARRAY, NULL)
    if isinstance(x, list):
        return all(map(_valid, x))
    return isinstance(x, dict) and all(isinstance(k, str) and _valid(y) for k, y in x.items())


def _merge(a: Any, b: Any) -> Any:
    if a == b or b == NULL:
        return a
    if a == NULL:
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _merge(a[k], b[k]) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if isinstance(a, list) and isinstance(b, list):
        out = list(a)
        for x in b:
            nested = next((k for k, y in enumerate(out) if isinstance(y, dict) and isinstance(x, dict)), None)
            if nested is not None:
                out[nested] = _merge(out[nested], x)
            elif x not in out:
                out.append(x)
        return out
    return MIXED


def _learn(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _learn(y) for k, y in x.items()}
    if isinstance(x, list):
        out: list[Any] = []
        for y in x:
            out = _merge(out, [_learn(y)])
        return out
    return scalar.type_of(x)


def _of_type(d: T.DataType) -> Any:
    if isinstance(d, T.StructType):
        return {f.name: _of_type(f.dataType) for f in d.fields if not f.name.startswith("__")}
    if isinstance(d, T.ArrayType):
        return [_of_type(d.elementType)]
    if isinstance(d, (T.MapType, T.VariantType)):
        return {} if isinstance(d, T.MapType) else MIXED
    if isinstance(d, T.BooleanType):
        return BOOLEAN
    return STRING if isinstance(d, (T.StringType, T.DateType, T.BinaryType)) else NUMBER


@dataclass(frozen=True)
class Schema:
    """{event type: {field: type}}; a type is a name, a list of element types ([]: any) or a dict ({}: open)."""

    types: dict[str, dict[str, Any]] = field(default_factory=dict)
    allow_any: bool = True
    allow_generic: bool = False
    allow_missing: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.types, dict) or not all(isinstance(v, dict) and _valid(v) for v in self.types.values()):
            raise TypeError("a schema maps event types to fields and their types")

    def __bool__(self) -> bool:
        return bool(self.types)

    def event(self, name: str) -> bool:
        return not self.types or name in self.types or name == ANY and self.allow_any or name == GENERIC and self.allow_generic

    def field(self, event: str, path: tuple[str | int, ...]) -> Any:
        """The type at a path of an event type (any: the first type that has it), or None."""
        if not self.types:
            return MIXED
        if event == GENERIC and event not in self.types:
            return MIXED
        for x in list(self.types.values()) if event == ANY else [self.types.get(event, {})]:
            found = _below(x, path)
            if found is not None:
                return found
        return MIXED if self.allow_missing else None

    def merge(self, other: Schema) -> Schema:
        names = [*self.types, *(k for k in other.types if k not in self.types)]
        merged = {k: {**other.types.get(k, {}), **self.types.get(k, {})} for k in names}
        return Schema(merged, self.allow_any or other.allow_any, self.allow_generic or other.allow_generic, self.allow_missing or other.allow_missing)

    def flat(self) -> dict[str, Any]:
        """All types' fields as one."""
        out: dict[str, Any] = {}
        for fields in self.types.values():
            out = {**fields, **out}
        return out

    @staticmethod
    def learn(events: Any) -> Schema:
        """The schema of (type, data) pairs, merged; conflicts become mixed."""
        out: dict[str, Any] = {}
        for name, data in events:
            new = _learn(data)
            out[name] = _merge(out[name], new) if name in out else new
        return Schema(out)

    @staticmethod
    def of_frame(df: DataFrame) -> Schema:
        """The schema of a frame: its columns for each event type, or the merged shape of its VARIANT,
        aggregated in Spark."""
        from wakeline.plans.compiler import DATA
        from wakeline.sources.frames import TYPE

        if DATA in df.columns:
            rows = df.groupBy(TYPE).agg(F.call_function("schema_of_variant_agg", F.col(DATA)).alias("s")).collect()
            out = {}
            for r in rows:
                text = r.s.replace("OBJECT<", "STRUCT<")
                out[r[TYPE]] = _of_type(T._parse_datatype_string(text.replace("VOID", "STRING")))
            return Schema(out)
        shape = _of_type(df.schema)
        return Schema({r[0]: shape for r in df.select(TYPE).distinct().collect() if r[0] is not None})


def _below(x: Any, path: tuple[str | int, ...]) -> Any:
    for p in path:
        if x == MIXED or x == {}:
            return MIXED
        if isinstance(p, int):
            if x == ARRAY or x == []:
                return MIXED
            if not isinstance(x, list):
                return None
            x = x[0] if len(x) == 1 else MIXED
        else:
            if x == OBJECT:
                return MIXED
            if not isinstance(x, dict) or p not in x:
                return None
            x = x[p]
    return x


def kind_of(x: Any) -> str:
    return OBJECT if isinstance(x, dict) and x else MIXED if x == {} else ARRAY if isinstance(x, list) else x


@dataclass
class Checker:
    """Kinds of expressions, inferred bottom up; raises at the place of the fault."""

    text: str
    schema: Schema
    dialect: Dialect
    event: str = ANY
    variables: dict[str, Any] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    events: list[str] | None = None
    extra: dict[str, Any] | None = None
    custom: frozenset[str] = frozenset()

    def fault(self, cls: type[ParseError], message: str, x: t.Node) -> ParseError:
        return cls(message, self.text, max(0, x.at), 1)

    def shape(self, x: t.Node) -> Any:
        """What a schema says of a node: a kind, a list or a dict."""
        if isinstance(x, t.Field):
            return self.field(x)
        return self.kind(x)

    def field(self, x: t.Field) -> Any:
        if x.base in self.variables:
            found = _below(self.variables[x.base], x.path)
            if found is None:
                raise self.fault(SchemaFault, f"Unknown field {x.text()}", x)
            return found
        if x.var:
            raise self.fault(SemanticFault, f"Unknown variable ${x.base}", x)
        if x.base in self.aliases and x.path:
            found = self.schema.field(self.aliases[x.base], x.path)
            if found is None:
                raise self.fault(SchemaFault, f"Unknown field {x.text()}", x)
            return found
        path: tuple[str | int, ...] = (x.base, *x.path)
        event = self.event
        if self.extra is not None and x.base in self.extra:
            return _below(self.extra, path)
        if self.events is not None:
            if x.base == "events" and x.path and isinstance(x.path[0], int):
                if x.path[0] >= len(self.events):
                    raise self.fault(SchemaFault, f"There is no event {x.path[0]}", x)
                event, path = self.events[x.path[0]], x.path[1:]
            else:
                event = self.events[0]
        found = self.schema.field(event, path)
        if found is not None:
            return found
        if self.dialect.enum_fields and len(path) > 1 and self.schema.field(event, path[:-1]) == STRING and isinstance(path[-1], str):
            return BOOLEAN
        if x.optional and not self.dialect.validate_optional or self.dialect.ignore_missing_fields:
            return MIXED
        raise self.fault(SchemaFault, f"Unknown field {x.text()} of {event}", x)

    def kind(self, x: t.Node) -> str:
        if isinstance(x, t.Literal):
            return scalar.type_of(x.value)
        if isinstance(x, t.Field):
            return kind_of(self.field(x))
        if isinstance(x, t.Not):
            self.condition(x.value)
            return BOOLEAN
        if isinstance(x, (t.And, t.Or)):
            for y in x.terms:
                self.condition(y)
            return BOOLEAN
        if isinstance(x, t.IsNull):
            self.kind(x.value)
            return BOOLEAN
        if isinstance(x, t.Compare):
            a, b = self.kind(x.left), self.kind(x.right)
            if not self.fit(a, b) or {a, b} & {ARRAY, OBJECT}:
                raise self.fault(TypeFault, f"Cannot compare {a} with {b}", x)
            if x.op not in ("==", "!=") and BOOLEAN in (a, b):
                raise self.fault(TypeFault, "Booleans have no order", x)
            return BOOLEAN
        if isinstance(x, t.InSet):
            a = self.kind(x.value)
            if a in (ARRAY, OBJECT):
                raise self.fault(TypeFault, f"Cannot look for {a} in a set", x)
            for m in x.members:
                if not self.fit(a, self.kind(m)):
                    raise self.fault(TypeFault, f"Cannot compare {a} with {self.kind(m)}", m)
            return BOOLEAN
        if isinstance(x, t.Arith):
            for y in (x.left, x.right):
                if not self.fit(self.kind(y), NUMBER):
                    raise self.fault(TypeFault, f"A number was expected, not {self.kind(y)}", y)
            return NUMBER
        if isinstance(x, t.Relation):
            Checker(self.text, self.schema, self.dialect, custom=self.custom).event_query(x.query)
            return BOOLEAN
        if isinstance(x, t.Call):
            return self.call(x)
        raise CompileError(f"{type(x).__name__} has no kind")

    @staticmethod
    def fit(a: str, b: str) -> bool:
        return a == b or MIXED in (a, b) or NULL in (a, b)

    def condition(self, x: t.Node) -> None:
        k = self.kind(x)
        if k not in (BOOLEAN, MIXED, NULL) and not self.dialect.implied_booleans:
            raise self.fault(TypeFault, f"A condition was expected, not {k}", x)

    def call(self, x: t.Call) -> str:
        f = scalar.REGISTRY.get(x.name)
        if f is None:
            if x.name in self.custom or self.dialect.ignore_missing_functions:
                for a in x.args:
                    self.kind(a)
                return MIXED
            raise self.fault(SemanticFault, f"Unknown function {x.name}", x)
        n = len(x.args)
        if n < f.needed or f.rest is None and n > len(f.args):
            raise self.fault(SemanticFault, f"{x.name} takes {f.needed} arguments{' or more' if f.rest else ''}, not {n}", x)
        if f.lambdas:
            array, variable, body = x.args
            shape = self.shape(array)
            if not self.fit(kind_of(shape), ARRAY):
                raise self.fault(TypeFault, f"{x.name} looks in arrays, not in {kind_of(shape)}", array)
            if not isinstance(variable, t.Field) or variable.path:
                raise self.fault(SemanticFault, f"{x.name}: a variable was expected", variable)
            element = shape[0] if isinstance(shape, list) and len(shape) == 1 else MIXED
            inner = Checker(self.text, self.schema, self.dialect, self.event, {**self.variables, variable.base: element}, self.aliases, self.events, self.extra, self.custom)
            inner.condition(body)
            return f.returns
        kinds = [self.kind(a) for a in x.args]
        swapped = f.literal == 1 and n == 2 and isinstance(x.args[0], t.Literal) and not isinstance(x.args[1], t.Literal) and x.name != "number"
        for k, (a, kind) in enumerate(zip(x.args, kinds, strict=True)):
            wanted = f.kinds(k)
            if not any(self.fit(kind, w) for w in wanted):
                raise self.fault(TypeFault, f"{x.name}: {' or '.join(wanted)} was expected, not {kind}", a)
            if f.literal is not None and (k >= f.literal) != (swapped and k < 2) and not (swapped and k == 1):
                if k >= f.literal or swapped:
                    if not isinstance(a, t.Literal) or a.value is None and x.name != "number":
                        raise self.fault(SemanticFault, f"{x.name}: a literal was expected", a)
        literals = [a for a in x.args if isinstance(a, t.Literal) and isinstance(a.value, str)]
        try:
            if x.name == "cidrMatch":
                for a in literals[-(n - 1) :]:
                    scalar.network(a.value)
            if x.name in ("match", "matchLite"):
                import re

                for a in literals:
                    re.compile(a.value)
        except Exception as e:
            raise self.fault(SemanticFault, f"{x.name}: {e}", x) from e
        return kinds[0] if f.returns == "same" else f.returns

    def event_query(self, q: t.EventQuery) -> None:
        if not self.schema.event(q.event):
            raise self.fault(SchemaFault, f"Unknown event type {q.event}", q)
        self.event = q.event
        self.condition(q.where)

    def query(self, q: t.Query) -> None:
        base = q.base
        if isinstance(base, t.EventQuery):
            self.event_query(base)
        else:
            keys: list[list[str]] = []
            for s in (*base.steps, *([u] if (u := getattr(base, "until", None)) else [])):  # type: ignore[attr-defined]
                self.event_query(s.query)
                keys.append([self.kind(b) for b in s.by])
                for b in s.by:
                    if isinstance(b, t.Literal):
                        raise self.fault(SemanticFault, "A by value must depend on the event", b)
                if s.alias:
                    self.aliases = {**self.aliases, s.alias: s.query.event}
            for at, kinds in enumerate(zip(*keys, strict=True)):
                if any(not self.fit(a, b) for a in kinds for b in kinds):
                    raise self.fault(TypeFault, f"By values have different types: {', '.join(kinds)}", base.steps[0].by[at])  # type: ignore[attr-defined]
            self.events = [s.query.event for s in base.steps]  # type: ignore[attr-defined]
        self.variables = {}
        for p in q.pipes:
            self.pipe(p)

    def pipe(self, p: t.Pipe) -> None:
        from wakeline.operators.pipes import PIPES

        if p.name not in PIPES:
            raise self.fault(SemanticFault, f"Unknown pipe {p.name}", p)
        n = len(p.args)
        if p.name in ("head", "tail"):
            a = p.args[0] if n else None
            if n > 1 or a is not None and not (isinstance(a, t.Literal) and isinstance(a.value, int) and not isinstance(a.value, bool) and a.value > 0):
                raise self.fault(SemanticFault, f"{p.name} takes one number above 0", p)
        elif p.name == "filter":
            if n != 1:
                raise self.fault(SemanticFault, "filter takes one condition", p)
            self.condition(p.args[0])
        elif p.name in ("unique", "sort", "unique_count", "count"):
            if not n and p.name != "count":
                raise self.fault(SemanticFault, f"{p.name} needs a value", p)
            for a in p.args:
                self.kind(a)
                if isinstance(a, t.Literal):
                    raise self.fault(SemanticFault, f"{p.name}: a value that depends on the event was expected", a)
        counts = {"count": NUMBER, "percent": NUMBER, "total_hosts": NUMBER, "hosts": [STRING]}
        if p.name == "count":
            self.extra, self.events, self.event = {**counts, "key": MIXED}, None, ANY
            self.schema = Schema({"count": self.extra}) if self.schema else self.schema
        elif p.name == "unique_count":
            self.extra = {**(self.extra or {}), **counts}
