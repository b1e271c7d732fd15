"""Macros and constants: expanded in the tree before anything is planned."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from wakeline.errors import SemanticFault
from wakeline.plans import tree as t


@dataclass
class Definitions:
    """Names to constants, macros, and Python functions from argument nodes to a node."""

    constants: dict[str, t.Literal] = field(default_factory=dict)
    macros: dict[str, t.Macro] = field(default_factory=dict)
    custom: dict[str, Callable[[list[t.Node]], t.Node]] = field(default_factory=dict)

    def add(self, definitions: Iterable[t.Node]) -> None:
        for d in definitions:
            name = d.name  # type: ignore[attr-defined]
            if name in self.constants or name in self.macros or name in self.custom:
                raise SemanticFault(f"{name} is defined twice", "", d.at)
            if isinstance(d, t.Constant):
                self.constants[name] = d.value
            elif isinstance(d, t.Macro):
                self.macros[name] = replace(d, body=self.expand(d.body, frozenset(d.params)))

    def copy(self) -> Definitions:
        return Definitions(dict(self.constants), dict(self.macros), dict(self.custom))

    def expand(self, x: t.Node, hidden: frozenset[str] = frozenset()) -> t.Node:
        def one(y: t.Node) -> t.Node:
            if isinstance(y, t.Field) and not y.path and y.base in self.constants and y.base not in hidden:
                return replace(self.constants[y.base], at=y.at)
            if isinstance(y, t.Call) and y.name in self.custom:
                return self.custom[y.name](list(y.args))
            if isinstance(y, t.Call) and y.name in self.macros:
                m = self.macros[y.name]
                if len(y.args) != len(m.params):
                    raise SemanticFault(f"{y.name} takes {len(m.params)} arguments, not {len(y.args)}", "", y.at)
                return _fill(m.body, dict(zip(m.params, y.args, strict=True)))
            return y

        return t.rewrite(x, one)


def _fill(body: t.Node, values: dict[str, t.Node]) -> t.Node:
    def one(y: t.Node) -> t.Node:
        if not isinstance(y, t.Field) or y.base not in values:
            return y
        v = values[y.base]
        if not y.path:
            return v
        if isinstance(v, t.Field):
            return replace(v, path=(*v.path, *y.path))
        raise SemanticFault(f"{v.text()} has no fields", "", y.at)

    # comparisons with a wildcard literal turn into wildcard calls once the literal is known
    def wild(y: t.Node) -> t.Node:
        if isinstance(y, t.Compare) and y.op in ("==", "!="):
            for a, b in ((y.left, y.right), (y.right, y.left)):
                if isinstance(b, t.Literal) and isinstance(b.value, str) and "*" in b.value:
                    call = t.Call("wildcard", (a, b), at=y.at)
                    return call if y.op == "==" else t.Not(call, at=y.at)
                if isinstance(b, t.Literal) and b.value is None:
                    return t.IsNull(a, y.op == "!=", at=y.at)
        return y

    return t.rewrite(t.rewrite(body, one), wild)
