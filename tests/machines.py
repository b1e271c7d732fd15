"""The language's order-dependent operators as literal state machines over event dicts, one event at a time."""

from __future__ import annotations

from wakeline.functions.scalar import Context
from wakeline.plans import tree as t
from wakeline.plans.compiler import evaluate


def true(x, event, context=Context()):
    return bool(evaluate(x, event, context))


def wants(q, event, context=Context()):
    return q.event in ("any", event["__type"]) and true(q.where, event, context)


def key_of(step, event, context=Context()):
    return tuple(context.py(evaluate(b, event, context)) for b in step.by)


def sequence(q, events, span=None, context=Context()):
    """Matches as lists of events, in the order they complete."""
    n = len(q.steps)
    waiting: list[dict] = [{} for _ in range(n)]
    out = []
    for e in events:
        if span is not None:
            for table in waiting:
                for k in [k for k, partial in table.items() if partial and partial[0]["__time"] < e["__time"] - span]:
                    del table[k]
        if q.until and wants(q.until.query, e, context):
            for table in waiting:
                table.pop(key_of(q.until, e, context), None)
        for p in range(n - 1, -1, -1):
            step = q.steps[p]
            if step.missing:
                if step.query.event not in ("any", e["__type"]):
                    continue
                go = not true(step.query.where, e, context)
            elif not wants(step.query, e, context):
                continue
            else:
                go = True
            k = key_of(step, e, context)
            if p == 0:
                if go:
                    waiting[1][k] = [] if step.missing else [e]
                continue
            if k not in waiting[p]:
                continue
            partial = waiting[p][k]
            if step.missing or not step.fork:
                del waiting[p][k]
            if not go:
                continue
            partial = partial if step.missing else [*partial, e]
            if p == n - 1:
                out.append(partial)
            else:
                waiting[p + 1][k] = partial
    return out


def join(q, events, context=Context()):
    slots: dict = {}
    out = []
    for e in events:
        if q.until and wants(q.until.query, e, context):
            slots.pop(key_of(q.until, e, context), None)
        for p, step in enumerate(q.steps):
            if not wants(step.query, e, context):
                continue
            k = key_of(step, e, context)
            mine = slots.setdefault(k, [None] * len(q.steps))
            if mine[p] is None:
                mine[p] = e
            if None not in mine:
                out.append(mine)
                del slots[k]
    return out


def sample(q, events, context=Context()):
    held: dict = {}
    out = []
    for e in events:
        for step in reversed(q.steps):
            if wants(step.query, e, context):
                mine = held.setdefault(key_of(step, e, context), [])
                mine.append(e)
                if len(mine) == len(q.steps):
                    out.append(list(mine))
                    mine.clear()
    return out


def related(kind, inner, events, context=Context()):
    """Whether the relation holds at each event."""
    matched: set = set()  # pids of inner matches
    born: set = set()  # pids created by a matched pid (or, for descendants, by one of these)
    dying: set = set()
    out = []
    for e in events:
        pid = e.get("pid")
        create, end = e.get("subtype") in ("create", "fork"), e.get("subtype") == "terminate"
        if e["__type"] == "process":
            matched -= dying
            born -= dying
            dying = set()
            if create and pid == 4 and e.get("process_name") == "System":
                matched, born = set(), set()
            if create and (e.get("ppid") in matched or kind == "descendant" and e.get("ppid") in born):
                born.add(pid)
            if end:
                dying.add(pid)
        if wants(inner, e, context) and pid:
            matched.add(pid)
        out.append(pid in (matched if kind == "event" else born))
    return out
