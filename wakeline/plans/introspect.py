"""Questions about a parsed query, answered without running it."""

from __future__ import annotations

from typing import Any

from wakeline.plans import tree as t


def query_type(q: t.Query) -> str:
    """event, sequence, join or sample."""
    return {t.EventQuery: "event", t.Sequence: "sequence", t.Join: "join", t.Sample: "sample"}[type(q.base)]  # type: ignore[index]


def uses_ancestry(q: t.Node) -> bool:
    return any(isinstance(x, t.Relation) for x in t.walk(q))


def is_stateful(q: t.Query) -> bool:
    """Whether results depend on more than one event."""
    return not isinstance(q.base, t.EventQuery) or uses_ancestry(q) or any(p.name != "filter" for p in q.pipes)


def required_event_types(q: t.Node) -> set[str]:
    """Types that the query reads, in subqueries and relationships too."""
    out = {x.event for x in t.walk(q) if isinstance(x, t.EventQuery)}
    if any(isinstance(x, t.Relation) and x.kind in ("child", "descendant", "event") for x in t.walk(q)) and "any" not in out:
        out.add("process")
    return out


def output_types(q: t.Query) -> list[str]:
    """The type of each event of a result; a count gives generic rows."""
    if any(p.name == "count" for p in q.pipes):
        return ["generic"]
    if isinstance(q.base, t.EventQuery):
        return [q.base.event]
    return [s.query.event for s in q.base.steps]  # type: ignore[attr-defined]


def query_terms(q: t.Query) -> list[str]:
    """The texts of the event queries, in order."""
    return [q.base.text()] if isinstance(q.base, t.EventQuery) else [s.query.text() for s in q.base.steps]  # type: ignore[attr-defined]


def match_kv(values: dict[str, Any]) -> t.Node:
    """A condition that fields equal values; lists mean any of them, `*` is a wildcard."""
    terms: list[t.Node] = []
    for name in sorted(values):
        found = values[name] if isinstance(values[name], list) else [values[name]]
        base, *rest = name.split(".")
        f = t.Field(base, tuple(rest))
        wild = tuple(t.Literal(v) for v in found if isinstance(v, str) and "*" in v)
        exact = tuple(t.Literal(v) for v in found if not (isinstance(v, str) and "*" in v))
        options: list[t.Node] = [t.Call("wildcard", (f, *wild))] if wild else []
        if exact:
            options.append(t.InSet(f, exact) if len(exact) > 1 else t.Compare("==", f, exact[0]))
        terms.append(options[0] if len(options) == 1 else t.Or(tuple(options)) if options else t.Literal(False))
    return t.Literal(True) if not terms else terms[0] if len(terms) == 1 else t.And(tuple(terms))
