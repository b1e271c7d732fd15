"""The query as frozen nodes. Equality ignores positions; text() renders a query that parses to equal nodes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

_ESCAPES = {"\b": r"\b", "\t": r"\t", "\r": r"\r", "\n": r"\n", "\f": r"\f", "\\": r"\\", '"': r"\""}
_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


@dataclass(frozen=True)
class Node:
    at: int = field(default=-1, compare=False, repr=False, kw_only=True)

    def text(self) -> str:
        raise NotImplementedError


@dataclass(frozen=True)
class Literal(Node):
    value: Any  # None, bool, int, float or str

    def text(self) -> str:
        v = self.value
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        if isinstance(v, str):
            return '"' + "".join(_ESCAPES.get(c, c) for c in v) + '"'
        return repr(v)


@dataclass(frozen=True)
class Field(Node):
    """base.path; names are strings, places in arrays are numbers. var: a $variable."""

    base: str
    path: tuple[str | int, ...] = ()
    optional: bool = False
    var: bool = False

    def text(self) -> str:
        name = lambda s: s if _PLAIN.match(s) else f"`{s}`"
        rest = "".join(f"[{p}]" if isinstance(p, int) else f".{name(p)}" for p in self.path)
        return "?" * self.optional + "$" * self.var + name(self.base) + rest


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]
    method: bool = False

    def text(self) -> str:
        if self.method:
            return f"{_wrap(self.args[0], 8)}:{self.name}({', '.join(a.text() for a in self.args[1:])})"
        return f"{self.name}({', '.join(a.text() for a in self.args)})"


@dataclass(frozen=True)
class Arith(Node):
    op: str
    left: Node
    right: Node

    def text(self) -> str:
        mine = _rank(self)
        return f"{_wrap(self.left, mine)} {self.op} {_wrap(self.right, mine + 1)}"


@dataclass(frozen=True)
class Compare(Node):
    op: str
    left: Node
    right: Node

    def text(self) -> str:
        return f"{_wrap(self.left, 5)} {self.op} {_wrap(self.right, 5)}"


@dataclass(frozen=True)
class IsNull(Node):
    value: Node
    negated: bool = False

    def text(self) -> str:
        return f"{_wrap(self.value, 5)} {'!=' if self.negated else '=='} null"


@dataclass(frozen=True)
class InSet(Node):
    value: Node
    members: tuple[Node, ...]

    def text(self) -> str:
        return f"{_wrap(self.value, 5)} in ({', '.join(m.text() for m in self.members)})"


@dataclass(frozen=True)
class Not(Node):
    value: Node

    def text(self) -> str:
        v = self.value
        if isinstance(v, InSet):
            return f"{_wrap(v.value, 5)} not in ({', '.join(m.text() for m in v.members)})"
        return f"not {_wrap(v, 3)}"


@dataclass(frozen=True)
class And(Node):
    terms: tuple[Node, ...]

    def text(self) -> str:
        return " and ".join(_wrap(t, 3) for t in self.terms)


@dataclass(frozen=True)
class Or(Node):
    terms: tuple[Node, ...]

    def text(self) -> str:
        return " or ".join(_wrap(t, 2) for t in self.terms)


@dataclass(frozen=True)
class EventQuery(Node):
    event: str
    where: Node

    def text(self) -> str:
        return f"{self.event} where {self.where.text()}"


@dataclass(frozen=True)
class Relation(Node):
    """event, child or descendant of an inner query."""

    kind: str
    query: EventQuery

    def text(self) -> str:
        return f"{self.kind} of [{self.query.text()}]"


@dataclass(frozen=True)
class Step(Node):
    """A subquery of a sequence, join or sample, with its own keys after the shared ones."""

    query: EventQuery
    by: tuple[Node, ...] = ()
    fork: bool = False
    missing: bool = False
    alias: str | None = None

    def text(self) -> str:
        out = f"{'!' * self.missing}[{self.query.text()}]"
        out += " fork=true" * self.fork
        out += f" by {', '.join(b.text() for b in self.by)}" if self.by else ""
        return out + (f" as {self.alias}" if self.alias else "")


@dataclass(frozen=True)
class Span(Node):
    amount: int | float
    unit: str = "s"

    @property
    def seconds(self) -> float:
        return self.amount * UNITS[self.unit]

    def text(self) -> str:
        return f"{self.amount}{self.unit}"


@dataclass(frozen=True)
class Sequence(Node):
    steps: tuple[Step, ...]
    until: Step | None = None
    maxspan: Span | None = None

    def text(self) -> str:
        head = "sequence" + (f" with maxspan={self.maxspan.text()}" if self.maxspan else "")
        return "\n  ".join([head, *(s.text() for s in self.steps), *([f"until {self.until.text()}"] if self.until else [])])


@dataclass(frozen=True)
class Join(Node):
    steps: tuple[Step, ...]
    until: Step | None = None

    def text(self) -> str:
        return "\n  ".join(["join", *(s.text() for s in self.steps), *([f"until {self.until.text()}"] if self.until else [])])


@dataclass(frozen=True)
class Sample(Node):
    steps: tuple[Step, ...]

    def text(self) -> str:
        return "\n  ".join(["sample", *(s.text() for s in self.steps)])


@dataclass(frozen=True)
class Pipe(Node):
    name: str
    args: tuple[Node, ...] = ()

    def text(self) -> str:
        return f"| {self.name} {', '.join(a.text() for a in self.args)}".rstrip()


@dataclass(frozen=True)
class Query(Node):
    base: Node
    pipes: tuple[Pipe, ...] = ()

    def text(self) -> str:
        return "\n".join([self.base.text(), *(p.text() for p in self.pipes)])


@dataclass(frozen=True)
class Constant(Node):
    name: str
    value: Literal

    def text(self) -> str:
        return f"const {self.name} = {self.value.text()}"


@dataclass(frozen=True)
class Macro(Node):
    name: str
    params: tuple[str, ...]
    body: Node

    def text(self) -> str:
        return f"macro {self.name}({', '.join(self.params)}) {self.body.text()}"


def _rank(x: Node) -> int:
    if isinstance(x, Or):
        return 1
    if isinstance(x, And):
        return 2
    if isinstance(x, Not):
        return 4 if isinstance(x.value, InSet) else 3
    if isinstance(x, (Compare, IsNull, InSet)):
        return 4
    if isinstance(x, Arith):
        return 6 if x.op in "*/%" else 5
    if isinstance(x, Literal) and isinstance(x.value, (int, float)) and not isinstance(x.value, bool) and x.value < 0:
        return 7
    return 9


def _wrap(x: Node, least: int) -> str:
    return x.text() if _rank(x) >= least else f"({x.text()})"


def children(x: Node) -> Iterator[Node]:
    for f in fields(x):
        v = getattr(x, f.name)
        if is_dataclass(v) and not isinstance(v, type):
            yield v
        elif isinstance(v, tuple):
            yield from (y for y in v if is_dataclass(y))


def walk(x: Node) -> Iterator[Node]:
    """x and all below it, parents first."""
    yield x
    for y in children(x):
        yield from walk(y)


def rewrite(x: Node, f: Callable[[Node], Node]) -> Node:
    """x with f applied to each node, children first."""
    new: dict[str, Any] = {}
    for a in fields(x):
        v = getattr(x, a.name)
        if is_dataclass(v) and not isinstance(v, type):
            w: Any = rewrite(v, f)
        elif isinstance(v, tuple):
            w = tuple(rewrite(y, f) if is_dataclass(y) else y for y in v)
        else:
            continue
        if w != v or w is not v:
            new[a.name] = w
    return f(replace(x, **new) if new else x)
