"""Rewrites of the tree that Catalyst has no counterpart of, and constant folding for the checks."""

from __future__ import annotations

from wakeline.functions import scalar
from wakeline.functions.scalar import Context
from wakeline.plans import tree as t
from wakeline.plans.compiler import evaluate

_FLIP = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
TRUE, FALSE = t.Literal(True), t.Literal(False)


def _constant(x: t.Node) -> bool:
    return isinstance(x, t.Literal)


def _key(context: Context, x: t.Node) -> object:
    return (scalar.type_of(x.value), context.py(x.value)) if isinstance(x, t.Literal) else x


def _set(context: Context, value: t.Node, members: list[t.Node], at: int) -> t.Node:
    """A set without repeats; of one member a comparison, of none false."""
    seen: dict[object, t.Node] = {}
    for m in members:
        seen.setdefault(_key(context, m), m)
    found = tuple(seen.values())
    if not found:
        return t.Literal(False, at=at)
    if len(found) == 1 and not (_constant(found[0]) and found[0].value is None):  # type: ignore[attr-defined]
        return t.Compare("==", value, found[0], at=at)
    return t.InSet(value, found, at=at)


def _as_set(x: t.Node) -> tuple[t.Node, list[t.Node], bool] | None:
    """(value, literal members, negated) of set tests and of comparisons with a literal."""
    negated = False
    if isinstance(x, t.Not) and isinstance(x.value, t.InSet):
        x, negated = x.value, True
    if isinstance(x, t.InSet) and all(map(_constant, x.members)):
        return x.value, list(x.members), negated
    if isinstance(x, t.Compare) and x.op in ("==", "!=") and not negated:
        for a, b in ((x.left, x.right), (x.right, x.left)):
            if _constant(b) and not _constant(a):
                return a, [b], x.op == "!="
    return None


def _any(context: Context, x: t.Or) -> t.Node:
    terms: list[t.Node] = []
    for y in x.terms:
        for z in y.terms if isinstance(y, t.Or) else [y]:
            if z == TRUE:
                return z
            if z == FALSE or z in terms:
                continue
            one = _as_set(z)
            for k, other in enumerate(terms):
                two = _as_set(other)
                if one and two and one[0] == two[0] and not one[2] and not two[2]:
                    terms[k] = _set(context, one[0], two[1] + one[1], other.at)
                    break
                if isinstance(z, t.Call) and isinstance(other, t.Call) and z.name == other.name and z.name in ("wildcard", "match") and z.args[0] == other.args[0]:
                    terms[k] = t.Call(z.name, (*other.args, *z.args[1:]), at=other.at)
                    break
            else:
                terms.append(z)
    return t.Literal(False, at=x.at) if not terms else terms[0] if len(terms) == 1 else t.Or(tuple(terms), at=x.at)


def _all(context: Context, x: t.And) -> t.Node:
    terms: list[t.Node] = []
    for y in x.terms:
        for z in y.terms if isinstance(y, t.And) else [y]:
            if z == FALSE:
                return z
            if z == TRUE or z in terms:
                continue
            one = _as_set(z)
            for k, other in enumerate(terms):
                two = _as_set(other)
                if not (one and two and one[0] == two[0]) or one[2] and two[2] and len(one[1]) + len(two[1]) < 3:
                    continue
                a, b = {_key(context, m) for m in two[1]}, {_key(context, m) for m in one[1]}
                if not two[2]:  # keep what the other allows, or does not forbid
                    terms[k] = _set(context, two[0], [m for m in two[1] if (_key(context, m) in b) != one[2]], other.at)
                elif not one[2]:
                    terms[k] = _set(context, one[0], [m for m in one[1] if _key(context, m) not in a], other.at)
                else:
                    terms[k] = t.Not(t.InSet(one[0], tuple({_key(context, m): m for m in two[1] + one[1]}.values())), at=other.at)
                break
            else:
                terms.append(z)
    return t.Literal(True, at=x.at) if not terms else terms[0] if len(terms) == 1 else t.And(tuple(terms), at=x.at)


def simplify(x: t.Node, context: Context = Context()) -> t.Node:
    """An equivalent tree: constants folded, nested and/or flattened, sets merged, `not` pushed in."""

    def one(y: t.Node) -> t.Node:
        if isinstance(y, t.Or):
            return _any(context, y)
        if isinstance(y, t.And):
            return _all(context, y)
        if isinstance(y, t.Not):
            z = y.value
            if isinstance(z, t.Not):
                return z.value if not isinstance(z.value, (t.Field, t.Literal, t.Call)) else y
            if isinstance(z, t.Compare) and z.left != z.right:
                return t.Compare(_FLIP[z.op], z.left, z.right, at=y.at)
            if isinstance(z, t.IsNull):
                return t.IsNull(z.value, not z.negated, at=y.at)
            if isinstance(z, t.Literal):
                return t.Literal(evaluate(y, {}, context), at=y.at)
            return y
        if isinstance(y, t.Compare):
            if _constant(y.left) and _constant(y.right) or y.left == y.right:
                return t.Literal(evaluate(y, {}, context), at=y.at)
            return y
        if isinstance(y, t.IsNull) and _constant(y.value):
            return t.Literal(evaluate(y, {}, context), at=y.at)
        if isinstance(y, t.InSet):
            if y.value in y.members or _constant(y.value) and all(map(_constant, y.members)):
                return t.Literal(evaluate(y, {}, context), at=y.at)
            return _set(context, y.value, list(y.members), y.at)
        if isinstance(y, t.Arith):
            if _constant(y.left) and _constant(y.right):
                return t.Literal(evaluate(y, {}, context), at=y.at)
            r = y.right
            if isinstance(r, t.Arith) and r.op == "-" and r.left == t.Literal(0) and y.op in "+-":
                return t.Arith("-" if y.op == "+" else "+", y.left, r.right, at=y.at)
            return y
        if isinstance(y, t.Call) and y.name in scalar.REGISTRY and all(map(_constant, y.args)) and y.args:
            f = scalar.REGISTRY[y.name]
            if f.py is not None:
                try:
                    return t.Literal(f.py(context, *(a.value for a in y.args)), at=y.at)  # type: ignore[attr-defined]
                except (ValueError, TypeError):
                    return y
        return y

    return t.rewrite(x, one)
