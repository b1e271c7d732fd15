"""Random expressions on random events: the compiled Columns against plain evaluation, typed and as VARIANT."""

import json
import random

from pyspark.sql import functions as F

from wakeline.plans import parser
from wakeline.plans.compiler import Compiler, Scope, evaluate
from wakeline.plans.simplify import simplify

KINDS = "a:long, b:string, t:boolean, o:struct<n:double,s:string>, l:array<string>, m:array<struct<k:long>>"


def event(r):
    some = lambda x: None if r.random() < 0.2 else x
    return {
        "a": some(r.randint(-4, 4)), "b": some(r.choice(["", "x", "Ab", "aB c", "10.0.0.7", "12"])), "t": some(r.random() < 0.5), "o": some({"n": some(r.choice([0.0, 1.5, -2.0])), "s": some(r.choice(["x", "ab"]))}),
        "l": some([r.choice(["x", "AB", "q"]) for _ in range(r.randint(0, 3))]), "m": some([{"k": r.randint(0, 3)} for _ in range(r.randint(0, 3))]),
    }


def number(r, depth):
    if depth and r.random() < 0.5:
        return f"({number(r, depth - 1)} {r.choice('+-*/%')} {number(r, depth - 1)})"
    return r.choice(["a", "o.n", "length(b)", "length(l)", 'indexOf(b, "b")', "m[0].k", "arrayCount(m, x, x.k > 1)", "number(b)", str(r.randint(-3, 5)), "2.5"])


def string(r):
    return r.choice(["b", "o.s", "l[0]", '"ab"', '"X"', "substring(b, 1)", "substring(b, -2, 9)", 'between(b, "a", "c")', "concat(b, a)", "string(a)", "string(t)"])


def condition(r, depth):
    if depth and r.random() < 0.7:
        a, b = condition(r, depth - 1), condition(r, depth - 1)
        return r.choice([f"({a} and {b})", f"({a} or {b})", f"not ({a})"])
    return r.choice([
        f"{number(r, 1)} {r.choice(['==', '!=', '<', '<=', '>', '>='])} {number(r, 1)}", f"{string(r)} {r.choice(['==', '!=', '<', '>='])} {string(r)}", f"{string(r)} == {number(r, 0)}", "t", "t == true", f"{r.choice(['a', 'b', 'o.s', 'l', 'm[1].k'])} {r.choice(['==', '!='])} null",
        f"{number(r, 0)} in (1, {number(r, 0)}, null)", f"{string(r)} not in (\"AB\", \"x\", {string(r)})", f"wildcard({r.choice(['b', 'o.s'])}, \"a*\", \"*1?\")", "b == \"*B*\"", f"match(b, \"a.\", {r.choice(['?\"1+$\"', '\"q\"'])})", "cidrMatch(b, \"10.0.0.0/8\")", "arrayContains(l, \"ab\")", "arraySearch(m, x, x.k == a)",
        "startsWith(b, \"a\")", "endsWith(o.s, \"B\")", "stringContains(b, o.s)",
    ])


def cases(seed, n):
    r = random.Random(seed)
    return [condition(r, 3) for _ in range(n)], [event(r) for _ in range(60)]


def same(a, b):
    return a is b or a is not None and b is not None and bool(a) == bool(b)


def compare(df, texts, events):
    c = Compiler(Scope.frame(df))
    got = df.orderBy("__ord").select(*[c.condition(parser.expression(x)).alias(f"c{k}") for k, x in enumerate(texts)]).collect()
    for e, row in zip(events, got, strict=True):
        for k, x in enumerate(texts):
            want = evaluate(parser.expression(x), e)
            assert same(row[k], None if want is None else bool(want)), (x, e, row[k], want)


def test_typed_columns(spark):
    texts, events = cases(1, 60)
    df = spark.createDataFrame([(k, e) for k, e in enumerate(events)], f"__ord long, e struct<{KINDS}>").select("__ord", "e.*")
    compare(df, texts, events)


def test_variants(spark):
    texts, events = cases(2, 25)
    df = spark.createDataFrame([(k, json.dumps(e)) for k, e in enumerate(events)], "__ord long, j string").select("__ord", F.parse_json("j").alias("__data"))
    compare(df, texts, events)


def test_simplified_filters_keep_the_same_events():
    """What a filter keeps is the same before and after the rewrites (they may turn unknown into false)."""
    texts, events = cases(3, 400)
    for x in texts:
        before = parser.expression(x)
        after = simplify(before)
        for e in events:
            a, b = evaluate(before, e), evaluate(after, e)
            if a is not None and b is not None:
                assert bool(a) == bool(b), (x, after.text(), e)
