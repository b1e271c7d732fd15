"""The functions of the language: how each is checked, computed on constants, and compiled to a Column.

`py` works on Python values (constants while compiling, and the tests' oracle); `build` makes the
Column from built-in expressions, so that calls stay inside generated code.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.errors import CompileError
from wakeline.functions import values as v
from wakeline.functions.values import ARRAY, BOOLEAN, MIXED, NUMBER, STRING, Value

PRIMITIVES = (NUMBER, STRING, BOOLEAN)


@dataclass(frozen=True)
class Context:
    """How strings compare: case is folded unless the engine is case-sensitive."""

    case_sensitive: bool = False

    def fold(self, col: Column) -> Column:
        return col if self.case_sensitive else F.lower(col)

    def py(self, x: Any) -> Any:
        return x if self.case_sensitive or not isinstance(x, str) else x.lower()


@dataclass(frozen=True)
class Function:
    """args: the kinds of each argument; rest: of any further ones; least: how many are needed.

    literal: the first argument from which on only literals are allowed. lambdas: the second argument
    names a variable that the third is about.
    """

    name: str
    args: tuple[tuple[str, ...], ...]
    returns: str
    build: Callable[[Context, list[Value]], Value]
    py: Callable[..., Any] | None = None
    rest: tuple[str, ...] | None = None
    least: int | None = None
    literal: int | None = None
    lambdas: bool = False

    @property
    def needed(self) -> int:
        return len(self.args) if self.least is None else self.least

    def kinds(self, k: int) -> tuple[str, ...]:
        return self.args[k] if k < len(self.args) else self.rest or ()


REGISTRY: dict[str, Function] = {}


def register(function: Function) -> Function:
    """Add a function to the language."""
    REGISTRY[function.name] = function
    return function


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


# arithmetic


def _pair(a: Value, b: Value) -> tuple[Column, Column, bool]:
    a, b = v.as_kind(a, NUMBER), v.as_kind(b, NUMBER)
    whole = (a.integral or a.known and a.value is None) and (b.integral or b.known and b.value is None)
    return (a.col, b.col, True) if whole else (a.col.cast("double"), b.col.cast("double"), False)


def _arith(py: Callable[[Any, Any], Any], f: Callable[[Column, Column, bool], Column]) -> tuple[Callable, Callable]:
    def build(_: Context, args: list[Value]) -> Value:
        a, b, whole = _pair(*args)
        return Value(f(a, b, whole), NUMBER, integral=whole)

    return build, lambda _, a, b: py(a, b) if number(a) and number(b) else None


def floor_divide(a: Column, b: Column) -> Column:
    """Whole division rounded down; null at zero."""
    safe = F.nullif(b, F.lit(0))
    odd = (F.try_mod(a, b) != 0) & ((a < 0) != (b < 0))
    return F.call_function("div", a, safe) - F.when(odd, F.lit(1)).otherwise(F.lit(0))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign; null at zero."""
    return F.try_mod(F.try_mod(a, b) + b, b)


def _divide(a: Any, b: Any) -> Any:
    if b == 0:
        return None
    return a // b if isinstance(a, int) and isinstance(b, int) else a / b


for _name, _py, _f in (
    ("add", lambda a, b: a + b, lambda a, b, _: F.try_add(a, b)),
    ("subtract", lambda a, b: a - b, lambda a, b, _: F.try_subtract(a, b)),
    ("multiply", lambda a, b: a * b, lambda a, b, _: F.try_multiply(a, b)),
    ("divide", _divide, lambda a, b, _: F.try_divide(a, b)),
    ("modulo", lambda a, b: None if b == 0 else a % b, lambda a, b, _: modulo(a, b)),
):
    _build, _fold = _arith(_py, _f)
    register(Function(_name, ((NUMBER,), (NUMBER,)), NUMBER, _build, _fold))


def _divide_build(_: Context, args: list[Value]) -> Value:
    """Mixed values are whole or not row by row."""
    a, b, whole = _pair(*args)
    if whole or all(x.kind != MIXED for x in args):
        return Value(floor_divide(a, b) if whole else F.try_divide(a, b), NUMBER, integral=whole)
    out = F.try_divide(a, b)
    both = reduce(and_, (v.variant_whole(x.col) if x.kind == MIXED else F.lit(x.integral) for x in args))
    return Value(F.when(both, F.floor(out).cast("double")).otherwise(out), NUMBER)


register(replace(REGISTRY["divide"], build=_divide_build))
OPERATORS = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide", "%": "modulo"}


# strings


def _strings(args: Sequence[Value]) -> list[Column]:
    return [v.as_kind(a, STRING).col for a in args]


def _py_strings(f: Callable[..., Any]) -> Callable[..., Any]:
    """f on strings, null if any argument is none."""
    return lambda ctx, *args: f(ctx, *args) if all(isinstance(a, str) for a in args) else None


def _test(name: str, method: str, default: bool | None, py: Callable[[str, str], bool]) -> None:
    def build(ctx: Context, args: list[Value]) -> Value:
        a, b = _strings(args)
        found = getattr(ctx.fold(a), method)(ctx.fold(b))
        return Value(found if default is None else F.coalesce(found, F.lit(default)), BOOLEAN)

    def fold(ctx: Context, a: Any, b: Any) -> Any:
        return py(ctx.py(a), ctx.py(b)) if isinstance(a, str) and isinstance(b, str) else default

    register(Function(name, ((STRING,), (STRING,)), BOOLEAN, build, fold))


_test("startsWith", "startswith", None, str.startswith)
_test("endsWith", "endswith", None, str.endswith)
_test("stringContains", "contains", False, str.__contains__)


def _concat(_: Context, args: list[Value]) -> Value:
    return Value(F.concat(*(v.text_of(a).col for a in args)), STRING)


def py_text(x: Any) -> str | None:
    return None if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float, str)) else None


def _py_concat(_: Context, *args: Any) -> str | None:
    parts = [py_text(a) for a in args]
    return None if None in parts else "".join(parts)  # type: ignore[arg-type]


register(Function("concat", (PRIMITIVES,), STRING, _concat, _py_concat, rest=PRIMITIVES))
register(Function("string", (PRIMITIVES,), STRING, lambda _, a: v.text_of(a[0]), lambda _, x: py_text(x)))


def _length(_: Context, args: list[Value]) -> Value:
    a = args[0]
    if a.kind == ARRAY:
        out = F.size(a.col)
    elif a.kind == MIXED:
        k = v.variant_kind(a.col)
        out = F.when(k == STRING, F.length(v.as_kind(a, STRING).col)).when(k == ARRAY, F.size(v.as_kind(a, ARRAY).col))
    else:
        out = F.length(v.as_kind(a, STRING).col)
    return Value(out.cast("bigint"), NUMBER, integral=True)


register(Function("length", ((STRING, ARRAY),), NUMBER, _length, lambda _, x: len(x) if isinstance(x, (str, list, dict)) else None))


def _slice(s: Column, start: Column, end: Column) -> Column:
    """Python's s[start:end]; bounds may be negative or beyond the ends."""
    n = F.length(s)
    clamp = lambda x: F.least(n, F.greatest(F.lit(0), F.when(x < 0, x + n).otherwise(x)))
    a, b = clamp(start), clamp(end)
    return F.when(s.isNotNull(), F.substring(s, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")))


def _substring(_: Context, args: list[Value]) -> Value:
    s = v.as_kind(args[0], STRING).col
    start = F.coalesce(v.as_kind(args[1], NUMBER).col.cast("bigint"), F.lit(0)) if len(args) > 1 else F.lit(0)
    end = F.coalesce(v.as_kind(args[2], NUMBER).col.cast("bigint"), F.length(s)) if len(args) > 2 else F.length(s)
    return Value(_slice(s, start, end), STRING)


register(Function("substring", ((STRING,), (NUMBER,), (NUMBER,)), STRING, _substring, lambda _, s, a=None, b=None: s[a:b] if isinstance(s, str) else None, least=1))


def _index_of(ctx: Context, args: list[Value]) -> Value:
    s, sub = (ctx.fold(x) for x in _strings(args[:2]))
    n = F.length(s)
    start = F.coalesce(v.as_kind(args[2], NUMBER).col.cast("bigint"), F.lit(0)) if len(args) > 2 else F.lit(0)
    start = F.when(start < 0, F.greatest(F.lit(0), start + n)).otherwise(start)
    found = F.position(sub, F.substring(s, (start + 1).cast("int"), n))
    return Value(F.when((found > 0) & (start <= n), found - 1 + start).cast("bigint"), NUMBER, integral=True)


def _py_index_of(ctx: Context, s: Any, sub: Any, start: Any = None) -> int | None:
    if not isinstance(s, str) or not isinstance(sub, str):
        return None
    found = ctx.py(s).find(ctx.py(sub), start or 0)
    return None if found < 0 else found


register(Function("indexOf", ((STRING,), (STRING,), (NUMBER,)), NUMBER, _index_of, _py_index_of, least=2))


def _between(ctx: Context, args: list[Value]) -> Value:
    s, left, right = _strings(args[:3])
    low, l, r = ctx.fold(s), ctx.fold(left), ctx.fold(right)
    at = F.position(l, low)
    start = at + F.length(l)
    rest = F.substring(low, start, F.length(low))
    near = F.position(r, rest) - 1
    back = F.position(F.reverse(r), F.reverse(rest))
    far = F.when(back > 0, F.length(rest) - back + 1 - F.length(r)).otherwise(F.lit(-1))
    greedy = F.coalesce(v.truth(args[3]), F.lit(False)) if len(args) > 3 else F.lit(False)
    n = F.when(greedy, far).otherwise(near)
    return Value(F.when((at > 0) & (n >= 0), F.substring(s, start, n)), STRING)


def _py_between(ctx: Context, s: Any, left: Any, right: Any, greedy: Any = False) -> str | None:
    if not all(isinstance(x, str) for x in (s, left, right)):
        return None
    low = ctx.py(s)
    at = low.find(ctx.py(left))
    if at < 0:
        return None
    at += len(left)
    end = low.rfind(ctx.py(right), at) if greedy else low.find(ctx.py(right), at)
    return s[at:end] if end >= 0 else None


register(Function("between", ((STRING,), (STRING,), (STRING,), (BOOLEAN,)), STRING, _between, _py_between, least=3))


DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
LIMB = 10**9


def _decimal_text(text: Column, base: int) -> Column:
    """Digits of a base as decimal text, whatever their number: limbs of nine places, least first, that take some digits at a
    time. A limb passes on what is above LIMB to the next one only, so it stays below 1.2 LIMB."""
    take = next(k for k in range(26, 0, -1) if base**k <= LIMB // 10)
    of = lambda x: F.lit(x).cast("bigint")
    over = lambda x: F.call_function("div", x, of(LIMB))
    padded = F.lpad(text, (F.ceil(F.length(text) / take) * take).cast("int"), "0")

    def step(limbs: Column, part: Column) -> Column:
        grown = F.transform(limbs, lambda x: x * of(base**take))
        low = F.concat(F.transform(grown, lambda x: x % of(LIMB)), F.array(of(0)))
        high = F.concat(F.array(F.conv(part, base, 10).cast("bigint")), F.transform(grown, over))
        return F.zip_with(low, high, lambda x, y: x + y)

    limbs = F.aggregate(F.regexp_extract_all(padded, F.lit(f".{{{take}}}"), F.lit(0)), F.array(of(0)), step)
    start = F.struct(of(0).alias("carry"), F.lit("").alias("text"))
    written = lambda a, x: F.struct(over(x + a["carry"]).alias("carry"), F.concat(F.lpad(((x + a["carry"]) % of(LIMB)).cast("string"), 9, "0"), a["text"]).alias("text"))
    return F.regexp_replace(F.aggregate(limbs, start, written, lambda a: F.concat(a["carry"].cast("string"), a["text"])), "^0+(?=.)", "")


def _number(_: Context, args: list[Value]) -> Value:
    s = v.as_kind(args[0], STRING).col
    base = args[1].value if len(args) > 1 else None
    sign = F.when(s.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    bare = F.lower(F.regexp_replace(s, "^[+-]", ""))

    def whole(text: Column, b: int) -> tuple[Column, Column]:
        """Digits of a base as a decimal of 38 places, null beyond those, and as decimal text of any length."""
        grow = lambda acc, c: F.try_add(F.try_multiply(acc, F.lit(b).cast("decimal(38,0)")), (F.instr(F.lit(DIGITS), c) - 1).cast("decimal(38,0)")).cast("decimal(38,0)")
        bare = F.regexp_replace(text, "^0+", "")
        value = F.aggregate(F.regexp_extract_all(bare, F.lit("."), F.lit(0)), F.lit(0).cast("decimal(38,0)"), grow)
        ok = text.rlike(f"^[{DIGITS[:b]}]+$")
        signed = F.when(sign < 0, -value).otherwise(value)
        size = F.coalesce(value.cast("string"), _decimal_text(bare, b))
        return F.when(ok, signed), F.when(ok, F.when((sign < 0) & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size))

    hexed = [F.when(bare.startswith("0x"), x) for x in whole(F.substring(bare, 3, F.length(bare)), 16)]
    if base not in (None, 10):
        col, digits = (F.coalesce(h, x) for h, x in zip(hexed, whole(bare, 16), strict=True)) if base == 16 else whole(bare, base)
        return Value(col, NUMBER, integral=True, digits=digits)
    plain = F.when(s.rlike(r"^[+-]?(\d*\.\d+|\d+)$"), s.try_cast("double"))
    return Value(plain if base == 10 else F.coalesce(plain, hexed[0].cast("double"), hexed[1].try_cast("double")), NUMBER)


def py_number(_: Context, s: Any, base: Any = None) -> Any:
    if not isinstance(s, str):
        return None
    try:
        if base in (None, 10) and re.fullmatch(r"[+-]?\d*\.\d+", s):
            return float(s)
        if base in (None, 16) and re.match(r"[+-]?0[xX]", s):
            return int(s, 16)
        return int(s, base or 10) if re.fullmatch(r"[+-]?[0-9a-zA-Z]+", s) else None
    except ValueError:
        return None


register(Function("number", ((STRING,), (NUMBER,)), NUMBER, _number, py_number, least=1, literal=1))


# patterns


def java_regex(pattern: str) -> str:
    """A Python regular expression in Java's notation."""
    return pattern.replace("(?P<", "(?<").replace("(?P=", r"\k<").replace(r"\Z", r"\z") if "(?P=" not in pattern else re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z"))


def _ordered(args: list[Value]) -> list[Value]:
    """The old order, pattern first, is accepted."""
    return [args[1], args[0]] if len(args) == 2 and args[0].known and not args[1].known else args


def _match(ctx: Context, args: list[Value]) -> Value:
    subject, *patterns = _ordered(args)
    joined = "|".join(java_regex(p.value) for p in patterns)
    return Value(v.as_kind(subject, STRING).col.rlike(f"(?{'' if ctx.case_sensitive else 'i'}su)^(?:{joined})"), BOOLEAN)


def _py_match(ctx: Context, s: Any, *patterns: str) -> bool | None:
    flags = re.DOTALL | re.UNICODE | (0 if ctx.case_sensitive else re.IGNORECASE)
    return re.match("|".join(f"(?:{p})" for p in patterns), s, flags) is not None if isinstance(s, str) else None


for _name in ("match", "matchLite"):
    register(Function(_name, ((STRING,), (STRING,)), BOOLEAN, _match, _py_match, rest=(STRING,), literal=1))


def like_pattern(glob: str) -> str:
    """A glob, in which only * is special, as a LIKE pattern."""
    return "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in glob)


def _wildcard(ctx: Context, args: list[Value]) -> Value:
    subject, *globs = _ordered(args)
    s = ctx.fold(v.as_kind(subject, STRING).col)
    return Value(reduce(or_, (s.like(like_pattern(ctx.py(g.value))) for g in globs)), BOOLEAN)


def _py_wildcard(ctx: Context, s: Any, *globs: str) -> bool | None:
    if not isinstance(s, str):
        return None
    return any(re.fullmatch(".*".join(map(re.escape, ctx.py(g).split("*"))), ctx.py(s), re.DOTALL) is not None for g in globs)


register(Function("wildcard", ((STRING,), (STRING,)), BOOLEAN, _wildcard, _py_wildcard, rest=(STRING,), literal=1))


def network(text: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    """A network in CIDR notation; its base is aligned to the prefix."""
    if "/" not in text:
        raise ValueError(f"{text!r} is no network")
    return ipaddress.ip_network(text, strict=False)


def _cidr(_: Context, args: list[Value]) -> Value:
    s = v.as_kind(args[0], STRING).col
    nets = [network(a.value) for a in args[1:]]
    tests: list[Column] = []
    four = [n for n in nets if n.version == 4]
    if four:
        ok = s.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
        address = reduce(lambda a, b: a * 256 + b, (F.split_part(s, F.lit("."), F.lit(k)).try_cast("bigint") for k in (1, 2, 3, 4)))
        ranges = (address.between(int(n.network_address), int(n.broadcast_address)) for n in four)
        tests.append(F.when(ok, reduce(or_, ranges)))
    six = [n for n in nets if n.version == 6]
    if six:
        # 128-bit addresses in many spellings: the one built-in that cannot be had from expressions
        @F.pandas_udf("boolean")
        def inside(column):  # type: ignore[no-untyped-def]
            def test(x):  # type: ignore[no-untyped-def]
                try:
                    a = ipaddress.ip_address(x)
                except ValueError:
                    return False
                return a.version == 6 and any(a in n for n in six)

            return column.map(lambda x: test(x) if isinstance(x, str) and ":" in x else False)

        tests.append(inside(s))
    return Value(F.coalesce(reduce(or_, (F.coalesce(x, F.lit(False)) for x in tests)), F.lit(False)), BOOLEAN)


def _py_cidr(_: Context, s: Any, *nets: str) -> bool:
    try:
        a = ipaddress.ip_address(s) if isinstance(s, str) else None
    except ValueError:
        a = None
    return a is not None and any(a.version == n.version and a in n for n in map(network, nets))


register(Function("cidrMatch", ((STRING,), (STRING,)), BOOLEAN, _cidr, _py_cidr, rest=(STRING,), literal=1))


# arrays


def _element(a: Value) -> Callable[[Column], Value]:
    return lambda x: v.typed(x, a.dtype.elementType)  # type: ignore[union-attr]


def _contains(ctx: Context, args: list[Value]) -> Value:
    a = v.as_kind(args[0], ARRAY)
    if a.dtype is None:
        return v.null(BOOLEAN)
    of = _element(a)
    test = lambda x: reduce(or_, (F.coalesce(equal(ctx, of(x), m), F.lit(False)) for m in args[1:]))
    return Value(F.exists(a.col, test), BOOLEAN)


def _py_contains(ctx: Context, a: Any, *members: Any) -> bool | None:
    if not isinstance(a, list):
        return None
    return any(type_of(x) == type_of(m) and ctx.py(x) == ctx.py(m) for x in a for m in members if m is not None)


register(Function("arrayContains", ((ARRAY,), PRIMITIVES), BOOLEAN, _contains, _py_contains, rest=PRIMITIVES))


def search(a: Value, f: Callable[[Value], Column]) -> Value:
    a = v.as_kind(a, ARRAY)
    if a.dtype is None:
        return Value(F.lit(False), BOOLEAN)
    return Value(F.coalesce(F.exists(a.col, lambda x: F.coalesce(f(_element(a)(x)), F.lit(False))), F.lit(False)), BOOLEAN)


def count(a: Value, f: Callable[[Value], Column]) -> Value:
    a = v.as_kind(a, ARRAY)
    if a.dtype is None:
        return v.literal(0)
    return Value(F.coalesce(F.size(F.filter(a.col, lambda x: F.coalesce(f(_element(a)(x)), F.lit(False)))), F.lit(0)).cast("bigint"), NUMBER, integral=True)


def _lambda_only(_: Context, args: list[Value]) -> Value:
    raise CompileError("a variable and a condition on it were expected")


register(Function("arraySearch", ((ARRAY,), ("variable",), (BOOLEAN,)), BOOLEAN, _lambda_only, lambdas=True))
register(Function("arrayCount", ((ARRAY,), ("variable",), (BOOLEAN,)), NUMBER, _lambda_only, lambdas=True))
register(Function("safe", ((NUMBER, STRING, BOOLEAN, ARRAY, "object"),), "same", lambda _, a: a[0], lambda _, x: x))


# comparison, shared by operators, sets and arrays


def type_of(x: Any) -> str:
    return v.NULL if x is None else BOOLEAN if isinstance(x, bool) else NUMBER if number(x) else STRING if isinstance(x, str) else ARRAY if isinstance(x, list) else v.OBJECT


def compare(ctx: Context, op: str, a: Value, b: Value) -> Column:
    """Null where either is null or the kinds differ."""
    f: dict[str, Callable[[Column, Column], Column]] = {
        "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
    }
    if a.kind == MIXED and b.kind == MIXED:
        out = F.lit(None).cast("boolean")
        for kind in (NUMBER, STRING, BOOLEAN):
            out = F.coalesce(out, compare(ctx, op, v.as_kind(a, kind), v.as_kind(b, kind)))
        return out
    kind = b.kind if a.kind == MIXED else a.kind
    if kind not in (NUMBER, STRING, BOOLEAN):
        return F.lit(None).cast("boolean")
    x, y = v.as_kind(a, kind).col, v.as_kind(b, kind).col
    if a.kind != MIXED and b.kind not in (kind, MIXED):
        return F.lit(None).cast("boolean")
    if kind == STRING:
        # folding a literal here keeps the other side's expression simple
        x = F.lit(ctx.py(a.value)) if a.known and a.value is not None else ctx.fold(x)
        y = F.lit(ctx.py(b.value)) if b.known and b.value is not None else ctx.fold(y)
    a, b = v.as_kind(a, kind), v.as_kind(b, kind)
    if a.digits is not None or b.digits is not None:
        # exact between whole numbers: as decimals if they fit, else by their digits
        return F.coalesce(f[op](x, y), f[op](v.rank_of(a), v.rank_of(b))) if a.integral and b.integral else f[op](v.double_of(a), v.double_of(b))
    return f[op](x, y)


def equal(ctx: Context, a: Value, b: Value) -> Column:
    return compare(ctx, "==", a, b)


def py_compare(ctx: Context, op: str, a: Any, b: Any) -> bool | None:
    if type_of(a) != type_of(b) or type_of(a) not in PRIMITIVES:
        return None
    a, b = ctx.py(a), ctx.py(b)
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
