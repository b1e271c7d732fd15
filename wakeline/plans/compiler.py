"""Expressions to Columns. Nothing here runs: names are looked up in a scope, types decide the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.errors import CompileError
from wakeline.functions import scalar
from wakeline.functions import values as v
from wakeline.functions.scalar import Context
from wakeline.functions.values import Value
from wakeline.plans import tree as t

#: Column of a frame that holds a whole event as VARIANT, for data without a fixed schema.
DATA = "__data"


def into(value: Value, path: tuple[str | int, ...]) -> Value:
    """A value below another: fields of objects, places of arrays, `word` of a string is equality."""
    for k, p in enumerate(path):
        d = value.dtype
        if isinstance(d, T.StructType) and isinstance(p, str) and p in d.fieldNames():
            value = v.typed(value.col.getField(p), d[p].dataType)
        elif isinstance(d, T.MapType) and isinstance(p, str):
            value = v.typed(F.try_element_at(value.col, F.lit(p)), d.valueType)
        elif isinstance(d, T.ArrayType) and isinstance(p, int):
            value = v.typed(F.get(value.col, F.lit(p)), d.elementType)
        elif value.kind == v.MIXED or isinstance(d, T.VariantType):
            step = f"$[{p}]" if isinstance(p, int) else "$['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']"
            found = F.try_variant_get(value.col, step, "variant")
            if k and k + 1 == len(path) and isinstance(p, str):
                word = v.as_kind(Value(value.col, v.MIXED), v.STRING).col == p
                found = F.coalesce(found, word.cast("variant"))
            value = Value(found, v.MIXED, T.VariantType())
        elif value.kind == v.STRING and isinstance(p, str):
            value = Value(value.col == p, v.BOOLEAN)
        else:
            return v.null()
    return value


@dataclass
class Scope:
    """Where names are looked up: the columns of a frame, then its VARIANT, then null."""

    schema: T.StructType
    of: Callable[[str], Column] = F.col
    events: Value | None = None  # array of a match's events
    variables: dict[str, Value] = field(default_factory=dict)
    aliases: dict[str, Value] = field(default_factory=dict)

    @staticmethod
    def frame(df: DataFrame) -> Scope:
        return Scope(df.schema, lambda c: F.col(f"`{c}`"))

    def field(self, x: t.Field) -> Value:
        if x.base in self.variables:
            return into(self.variables[x.base], x.path)
        if x.base in self.aliases:
            return into(self.aliases[x.base], x.path)
        if self.events is not None:
            own = x.base in self.schema.fieldNames() and x.base not in ("events",)
            if x.base == "events" and x.path and isinstance(x.path[0], int):
                return self._below(into(self.events, x.path[:1]), x.path[1:])
            if not own:
                return self._below(into(self.events, (0,)), (x.base, *x.path))
        if x.base in self.schema.fieldNames() and not x.base.startswith("__"):
            return into(v.typed(self.of(x.base), self.schema[x.base].dataType), x.path)
        if DATA in self.schema.fieldNames():
            return into(Value(self.of(DATA), v.MIXED, T.VariantType()), (x.base, *x.path))
        return v.null()

    @staticmethod
    def _below(event: Value, path: tuple[str | int, ...]) -> Value:
        d = event.dtype
        if isinstance(d, T.StructType) and path and path[0] not in d.fieldNames() and DATA in d.fieldNames():
            return into(event, (DATA, *path))
        return into(event, path)


@dataclass
class Compiler:
    """scope: the frame; relations: columns already made for ancestry tests; functions: custom ones."""

    scope: Scope
    context: Context = Context()
    relations: dict[t.Relation, Column] = field(default_factory=dict)
    functions: dict[str, Callable[[list[Value]], Value]] = field(default_factory=dict)

    def condition(self, x: t.Node) -> Column:
        """A condition as a boolean: null where unknown."""
        return v.truth(self.value(x))

    def value(self, x: t.Node) -> Value:
        return getattr(self, "_" + type(x).__name__.lower())(x)

    def _literal(self, x: t.Literal) -> Value:
        return v.literal(x.value)

    def _field(self, x: t.Field) -> Value:
        return self.scope.field(x)

    def _not(self, x: t.Not) -> Value:
        return Value(~self.condition(x.value), v.BOOLEAN)

    def _and(self, x: t.And) -> Value:
        return Value(reduce(and_, map(self.condition, x.terms)), v.BOOLEAN)

    def _or(self, x: t.Or) -> Value:
        return Value(reduce(or_, map(self.condition, x.terms)), v.BOOLEAN)

    def _isnull(self, x: t.IsNull) -> Value:
        y = self.value(x.value)
        if y.kind == v.NULL:
            return v.literal(not x.negated)
        col = (y.col if y.digits is None else y.digits).isNull()
        if y.kind == v.MIXED:
            col = v.variant_kind(y.col) == v.NULL
        return Value(~col if x.negated else col, v.BOOLEAN)

    def _compare(self, x: t.Compare) -> Value:
        if x.left == x.right and x.op in ("==", "<=", ">="):
            return v.literal(True)
        if x.left == x.right and x.op in ("!=", "<", ">"):
            return v.literal(False)
        return Value(scalar.compare(self.context, x.op, self.value(x.left), self.value(x.right)), v.BOOLEAN)

    def _inset(self, x: t.InSet) -> Value:
        if x.value in x.members:
            return v.literal(True)
        y = self.value(x.value)
        fixed = [m.value for m in x.members if isinstance(m, t.Literal)]
        tests: list[Column] = []
        if fixed or not x.members:
            # null members never match and never make the result unknown
            inside: list[Column] = []
            for kind in (v.NUMBER, v.STRING, v.BOOLEAN):
                same = [self.context.py(m) for m in fixed if scalar.type_of(m) == kind]
                if same and y.digits is not None and kind == v.NUMBER:
                    inside += [scalar.equal(self.context, y, v.literal(m)) for m in same]
                elif same and y.kind in (kind, v.MIXED):
                    col = v.as_kind(y, kind).col
                    inside.append((self.context.fold(col) if kind == v.STRING else col).isin(same))
            known = v.variant_kind(y.col) != v.NULL if y.kind == v.MIXED else (y.col if y.digits is None else y.digits).isNotNull()
            found = reduce(or_, (F.coalesce(i, F.lit(False)) for i in inside)) if inside else F.lit(False)
            tests.append(F.when(known, found))
        tests += [scalar.equal(self.context, y, self.value(m)) for m in x.members if not isinstance(m, t.Literal)]
        return Value(reduce(or_, tests), v.BOOLEAN)

    def _arith(self, x: t.Arith) -> Value:
        return scalar.REGISTRY[scalar.OPERATORS[x.op]].build(self.context, [self.value(x.left), self.value(x.right)])

    def _relation(self, x: t.Relation) -> Value:
        if x not in self.relations:
            raise CompileError("relationships are not supported here")
        return Value(self.relations[x], v.BOOLEAN)

    def _call(self, x: t.Call) -> Value:
        if x.name in self.functions:
            return self.functions[x.name]([self.value(a) for a in x.args])
        f = scalar.REGISTRY.get(x.name)
        if f is None:
            raise CompileError(f"unknown function {x.name}")
        if f.lambdas:
            array, variable, body = x.args
            if not isinstance(variable, t.Field) or variable.path:
                raise CompileError(f"{x.name}: a variable was expected")

            def inner(element: Value) -> Column:
                scope = Scope(self.scope.schema, self.scope.of, self.scope.events, {**self.scope.variables, variable.base: element}, self.scope.aliases)
                return Compiler(scope, self.context, self.relations, self.functions).condition(body)

            return (scalar.search if x.name == "arraySearch" else scalar.count)(self.value(array), inner)
        return f.build(self.context, [self.value(a) for a in x.args])


def key(compiler: Compiler, x: t.Node) -> Column:
    """An expression as a key: strings folded, numbers as double, mixed values as their JSON text."""
    y = compiler.value(x)
    if y.kind == v.STRING:
        return compiler.context.fold(y.col)
    if y.kind == v.NUMBER:
        return v.double_of(y)
    if y.kind == v.BOOLEAN:
        return y.col.cast("string")
    if y.kind == v.NULL:
        return F.lit(None).cast("string")
    text = F.to_json(y.col)
    return F.when(y.col.isNotNull() & (text != "null"), compiler.context.fold(text))


def evaluate(x: t.Node, event: dict[str, Any], context: Context = Context(), variables: dict[str, Any] | None = None) -> Any:
    """An expression on one event, in plain Python: constants while compiling, and the tests' oracle."""
    names = variables or {}
    go = lambda y: evaluate(y, event, context, names)
    truth = lambda y: None if y is None else bool(y)
    if isinstance(x, t.Literal):
        return x.value
    if isinstance(x, t.Field):
        y: Any = names[x.base] if x.base in names else event.get(x.base)
        for p in x.path:
            if isinstance(y, dict) and isinstance(p, str):
                y = y.get(p)
            elif isinstance(y, list) and isinstance(p, int):
                y = y[p] if p < len(y) else None
            elif isinstance(y, str) and isinstance(p, str):
                y = y == p
            else:
                return None
        return y
    if isinstance(x, t.Not):
        y = truth(go(x.value))
        return None if y is None else not y
    if isinstance(x, (t.And, t.Or)):
        stop = isinstance(x, t.Or)
        found = [truth(go(y)) for y in x.terms]
        return stop if stop in found else None if None in found else not stop
    if isinstance(x, t.IsNull):
        return (go(x.value) is None) != x.negated
    if isinstance(x, t.Compare):
        return x.op in ("==", "<=", ">=") if x.left == x.right else scalar.py_compare(context, x.op, go(x.left), go(x.right))
    if isinstance(x, t.InSet):
        if x.value in x.members:
            return True
        y, found = go(x.value), []
        fixed = [m.value for m in x.members if isinstance(m, t.Literal)]
        if fixed or not x.members:
            found.append(None if y is None else any(scalar.py_compare(context, "==", y, m) for m in fixed))
        found += [scalar.py_compare(context, "==", y, go(m)) for m in x.members if not isinstance(m, t.Literal)]
        return True if True in found else None if None in found else False
    if isinstance(x, t.Arith):
        return scalar.REGISTRY[scalar.OPERATORS[x.op]].py(context, go(x.left), go(x.right))  # type: ignore[misc]
    if isinstance(x, t.Call):
        f = scalar.REGISTRY[x.name]
        if f.lambdas:
            a, name = go(x.args[0]), x.args[1].base  # type: ignore[attr-defined]
            hits = [bool(evaluate(x.args[2], event, context, {**names, name: y})) for y in a] if isinstance(a, list) else []
            return any(hits) if x.name == "arraySearch" else sum(hits)
        args = [go(a) for a in x.args]
        if f.literal == 1 and len(args) == 2 and isinstance(x.args[0], t.Literal) and not isinstance(x.args[1], t.Literal) and x.name != "number":
            args.reverse()
        return f.py(context, *args)  # type: ignore[misc]
    raise CompileError(f"{type(x).__name__} has no value")
