"""Functions and operators: own tables of (expression, expected), on constants, on columns and on VARIANTs."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wakeline.api import Engine
from wakeline.functions.scalar import Context
from wakeline.plans import parser
from wakeline.plans.compiler import Compiler, Scope, evaluate
from wakeline.sources import frames

EVENT = {"s": "Hello World", "e": "", "n": 7, "m": -7, "z": 0, "d": 2.5, "t": True, "f": False, "a": ["x", "Y", "z"], "nums": [1, 2, 3], "none": None, "ip": "192.168.1.77", "six": "fe80::12", "hex": "0x1F", "o": {"p": "Q", "r": [{"k": 1}, {"k": 5}]}, "uni": "Straße 日本"}

TABLE = [
    # arithmetic: whole division rounds down, the remainder has the divisor's sign
    ("n + 1", 8), ("n - m", 14), ("n * d", 17.5), ("n / 2", 3), ("m / 2", -4), ("n / d", 2.8), ("n / 0", None), ("m % 3", 2), ("n % -3", -2), ("d % 2", 0.5), ("add(n, s)", None), ("-n", -7), ("-(n)", -7), ("none + 1", None), ("1 + 2 * 3 - 4", 3), ("n / 2.0", 3.5), ("modulo(n, 0)", None), ("multiply(n, none)", None),
    # comparison
    ('s == "hello world"', True), ('s == "hello"', False), ("n == 7.0", True), ("n == s", None), ("none == 1", None), ("none == null", True), ("s != null", True), ("n < 8 and m > -8", True), ('s < "i"', True), ("t == true", True), ("t == 1", None), ("missing == null", True), ("missing < 3", None), ('s == "*wor*"', True), ('s != "*wor*"', False), ('s == "h?llo*"', False), ("d >= 2.5", True), ("null < 3", None),
    # logic
    ("true or none == 1", True), ("none == 1 or false", None), ("false and none == 1", False), ("none == 1 and true", None), ("not (none == 1)", None), ("not n == 7", False), ("t and not f", True),
    # sets
    ('s in ("HELLO WORLD", "x")', True), ("n in (1, null, 7)", True), ("n in (1, null)", False), ("none in (1, 2)", None), ("n not in (1, 2)", True), ("n in (z + 7, 3)", True), ("n in (none, m)", None), ('n in ("7")', False), ("t in (true)", True),
    # strings
    ('startsWith(s, "HELL")', True), ('endsWith(s, "ld")', True), ('stringContains(s, "O W")', True), ('startsWith(none, "x")', None), ('stringContains(none, "x")', False), ("startsWith(n, s)", None), ('indexOf(s, "O")', 4), ('indexOf(s, "o", 5)', 7), ('indexOf(s, "q")', None), ('indexOf(s, "h", -20)', 0), ('indexOf(s, "l", -2)', 9), ('indexOf(s, "")', 0),
    ("length(s)", 11), ("length(e)", 0), ("length(a)", 3), ("length(n)", None), ("length(none)", None), ("length(uni)", 9), ("substring(s, 0, 5)", "Hello"), ("substring(s, -5)", "World"), ("substring(s, 2, -2)", "llo Wor"), ("substring(s, 8, 3)", ""), ("substring(s, -100, 3)", "Hel"), ("substring(s)", "Hello World"), ("substring(none, 1)", None), ("substring(uni, -2)", "日本"),
    ('between(s, "H", "o")', "ell"), ('between(s, "h", "O", true)', "ello W"), ('between(s, "x", "o")', None), ('between(s, "h", "q")', None), ('between(s, "", "o")', "Hell"), ('concat(s, "-", n, t, d)', "Hello World-7true2.5"), ("concat(s, none)", None), ("string(n)", "7"), ("string(t)", "true"), ("string(d)", "2.5"), ("string(none)", None),
    ('number("12")', 12), ('number("-12")', -12), ('number("1.5")', 1.5), ("number(hex)", 31), ('number("1f", 16)', 31), ('number("0x1f", 16)', 31), ('number("101", 2)', 5), ('number("-11", 2)', -3), ('number("12x")', None), ('number("")', None), ("number(none)", None), ('number("zz", 36)', 1295),
    # patterns
    ('match(s, "hello")', True), ('match(s, "world")', False), ('match(s, "x", ".*WORLD$")', True), ('match(s, "h(?P<v>e)llo\\\\b")'.replace("\\\\", "\\\\"), True), ("match(none, 'x')", None), ('matchLite(?".+o$", s)', False), ('wildcard(s, "*w*")', True), ('wildcard(s, "hello")', False), ('wildcard(s, "x", "*D")', True), ('wildcard("a_c", "a%c", "abc")', False), ("wildcard(n, 'x')", None), ('wildcard("a\\nb", "a*b")', True),
    # addresses
    ('cidrMatch(ip, "192.168.0.0/16")', True), ('cidrMatch(ip, "10.0.0.0/8", "192.168.1.64/27")', True), ('cidrMatch(ip, "192.168.1.99/28")', False), ('cidrMatch(none, "0.0.0.0/0")', False), ('cidrMatch(s, "0.0.0.0/0")', False), ('cidrMatch(six, "fe80::/10")', True), ('cidrMatch(six, "0.0.0.0/0")', False), ('cidrMatch(ip, "::/0")', False),
    # arrays
    ('arrayContains(a, "y")', True), ('arrayContains(a, "q", "Z")', True), ('arrayContains(a, "q")', False), ("arrayContains(nums, 2)", True), ("arrayContains(none, 1)", None), ('arrayContains(nums, "2")', False), ('arraySearch(a, x, x == "Y")', True), ("arraySearch(nums, x, x > n)", False), ("arrayCount(nums, x, x >= 2)", 2), ("arrayCount(none, x, true)", 0), ("arraySearch(none, x, true)", False),
    ("arraySearch(o.r, x, x.k > 4)", True), ("arrayCount(o.r, x, arraySearch(nums, y, y == x.k))", 1), ("a[1]", "Y"), ("a[7]", None), ("o.p", "Q"), ("o.r[1].k", 5), ("o.nope.more", None), ("s.x", False), ("o.p.Q", True), ("n.x", None), ("safe(n / 0)", None), ("safe(s)", "Hello World"),
    # methods
    ("s:length()", 11), ('s:substring(0, 5):concat("!")', "Hello!"), ('s:between("h", "o"):length() == 3', True),
]


def near(a, b):
    return a == b and (a is None or isinstance(a, bool) == isinstance(b, bool)) or isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) < 1e-12


@pytest.mark.parametrize("text, want", TABLE)
def test_constants(text, want):
    assert near(evaluate(parser.expression(text), EVENT), want)


def _run(df, scope):
    c = Compiler(scope)
    made = [c.value(parser.expression(text)).col for text, _ in TABLE]
    made = [m if k else m for k, m in enumerate(made)]
    return df.select(*[m.alias(f"c{k}") for k, m in enumerate(made)]).collect()


def _wrong(row):
    return [(text, want, row[k]) for k, (text, want) in enumerate(TABLE) if not near(float(row[k]) if isinstance(row[k], (int, float)) and not isinstance(row[k], bool) and isinstance(want, float) else row[k] if not (isinstance(row[k], float) and isinstance(want, int)) else int(row[k]), want)]


def test_columns(spark):
    kinds = "s string, e string, n int, m long, z short, d float, t boolean, f boolean, a array<string>, nums array<int>, none string, ip string, six string, hex string, o struct<p:string,r:array<struct<k:long>>>, uni string"
    df = spark.createDataFrame([EVENT], kinds)
    typed = [x for x in TABLE if "none" not in x[0]]
    (row,) = _run(df, Scope.frame(df))
    assert [w for w in _wrong(row) if w[0] in {t for t, _ in typed}] == []
    # a null column of the right kind gives what a null value gives
    nulls = [("none == 1", "long"), ("none in (1, 2)", "long"), ("none + 1", "double"), ("length(none)", "array<string>"), ("arrayContains(none, 1)", "array<long>"), ("arrayCount(none, x, true)", "array<long>"), ("startsWith(none, 'x')", "string"), ("stringContains(none, 'x')", "string"), ("cidrMatch(none, '0.0.0.0/0')", "string"), ("not none", "boolean")]
    for text, kind in nulls:
        one = df.withColumn("none", F.lit(None).cast(kind))
        (got,) = one.select(Compiler(Scope.frame(one)).value(parser.expression(text)).col).first()
        assert got == evaluate(parser.expression(text), EVENT), text


def test_variants(spark):
    """The same table with the whole event as a VARIANT: kinds are decided row by row."""
    import json

    df = spark.createDataFrame([(json.dumps(EVENT),)], "j string").select(F.parse_json("j").alias("__data"))
    as_json = {"o.r[1].k": "5", "s.x": "false", "o.p.Q": "true"}
    (row,) = df.select(*[_plain(Compiler(Scope.frame(df)).value(parser.expression(text))).alias(f"c{k}") for k, (text, _) in enumerate(TABLE)]).collect()
    assert {t: got for t, _, got in _wrong(row)} == as_json


def _plain(value):
    """A result that is a VARIANT itself as its string, or else its JSON read back in _wrong()."""
    return value.col if value.kind != "mixed" else _as_text(value.col)


def _as_text(col):
    kind = F.schema_of_variant(col)
    return F.when(kind == "STRING", F.try_variant_get(col, "$", "string")).when(kind != "VOID", F.to_json(col))


def test_variant_fields_as_numbers(spark):
    df = frames.from_events(spark, [{"v": 1}, {"v": "1"}, {"v": True}, {"v": 1.5}, {"v": None}, {}, {"v": [1]}, {"v": {"a": 1}}])
    c = Compiler(Scope.frame(df))
    of = lambda text: [r[0] for r in df.orderBy("__ord").select(c.value(parser.expression(text)).col).collect()]
    assert of("v == 1") == [True, None, None, False, None, None, None, None]
    assert of('v == "1"') == [None, True, None, None, None, None, None, None]
    assert of("v == null") == [False, False, False, False, True, True, False, False]
    assert of("v in (1, true)") == [True, False, True, False, None, None, False, False]
    assert of("v > 1") == [False, None, None, True, None, None, None, None]
    assert of("not v") == [False, False, False, False, None, None, False, False]


def test_case_sensitive(spark):
    df = spark.createDataFrame([("Ab",)], "s string")
    c = Compiler(Scope.frame(df), Context(True))
    texts = ['s == "ab"', 's == "Ab"', 'startsWith(s, "a")', 's in ("ab", "AB")', 'wildcard(s, "a*")', 'match(s, "a")', 'indexOf(s, "B")', 's == "A*"']
    assert list(df.select(*[c.value(parser.expression(x)).col for x in texts]).first()) == [False, True, False, False, False, False, None, True]
    assert [evaluate(parser.expression(x), {"s": "Ab"}, Context(True)) for x in texts] == [False, True, False, False, False, False, None, True]


def test_cidr_random_addresses(spark):
    r = random.Random(1)
    nets, rows = [], []
    for _ in range(12):
        bits = r.randint(0, 32)
        nets.append(ipaddress.ip_network((r.getrandbits(32), bits), strict=False))
        for _ in range(20):
            inside = int(nets[-1].network_address) + r.randrange(nets[-1].num_addresses)
            rows.append(str(ipaddress.ip_address(inside if r.random() < 0.5 else r.getrandbits(32))))
    rows += ["1.2.3", "1.2.3.256", "01.2.3.4", "", "1.2.3.4.5", "a.b.c.d", "1.2.3.4 "]
    df = spark.createDataFrame([(x,) for x in rows], "ip string")
    texts = [f'cidrMatch(ip, "{n}")' for n in nets]
    got = df.select("ip", *[Compiler(Scope.frame(df)).value(parser.expression(x)).col for x in texts]).collect()
    for row in got:
        assert list(row[1:]) == [evaluate(parser.expression(x), {"ip": row[0]}) for x in texts], row[0]


def test_slices_and_division_against_python(spark):
    bounds = [None, *range(-8, 9)]
    df = spark.createDataFrame([("abcdef", a, b) for a in bounds for b in bounds], "s string, a long, b long")
    c = Compiler(Scope.frame(df))
    for r in df.select("s", "a", "b", c.value(parser.expression("substring(s, a, b)")).col.alias("x"), c.value(parser.expression("a / b")).col.alias("q"), c.value(parser.expression("a % b")).col.alias("m")).collect():
        assert r.x == r.s[r.a : r.b]
        known = r.a is not None and r.b
        assert r.q == (r.a // r.b if known else None) and r.m == (r.a % r.b if known else None)


def test_filters_reach_the_scan(spark, tmp_path):
    """Comparisons and prefixes are pushed to Parquet; only named columns are read."""
    from wakeline.api import Config, Engine

    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 2.0, "x")], "id long, kind string, v double, other string").write.parquet(path)
    e = Engine(spark, Config(case_sensitive=True)).load(spark.read.parquet(path), type="kind", time=F.lit(0), order="id")
    plan = e.run('a where v > 1 and startsWith(kind, "a")').select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,a)" in plan and "GreaterThan(v,1.0)" in plan and "StringStartsWith(kind,a)" in plan and "other" not in plan.partition("ReadSchema")[2]


def test_numbers_of_any_length(spark):
    """Texts on both sides of 38 places and far beyond, in several bases, against Python's whole numbers."""
    r = random.Random(5)
    kinds = "0123456789abcdefghijklmnopqrstuvwxyz"
    bases = [2, 7, 16, 36]
    texts = ["-1234567890123456789" + str(10**6 + 3), "0", "-0", "-" + "0" * 50, "z" * 26, "x y", "", None]
    for b in bases:
        texts += [r.choice(["", "-", "+"]) + "".join(r.choice(kinds[:b]) for _ in range(n)) for n in (1, 3, 24, 25, 26, 27, 60, 130, 400)]
        texts += [in_base(x, b, kinds) for x in (10**38 - 1, 10**38, 10**38 + 1, -(10**38))]
    texts += ["0x" + "f" * 40, "-0X" + "1" * 33]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    c = Compiler(Scope.frame(df))
    edge = 10**38
    for b in bases:
        checks = [f"number(t, {b}) == null", f"number(t, {b}) > {edge}", f"number(t, {b}) <= -{edge - 1}", f"number(t, {b}) == {edge + 1}", f"number(t, {b}) in (0, {edge})", f"number(t, {b}) == number(t, 36)", f"number(t, {b}) < 1.5", f"string(number(t, {b}))", f"not number(t, {b})"]
        got = df.orderBy("k").select(*[c.value(parser.expression(x)).col.alias(f"c{k}") for k, x in enumerate(checks)]).collect()
        for text, row in zip(texts, got, strict=True):
            assert list(row) == [evaluate(parser.expression(x), {"t": text}) for x in checks], (b, text)
    rows = df.orderBy("k").select(c.value(parser.expression("number(t)")).col).collect()
    for text, (n,) in zip(texts, rows, strict=True):
        want = evaluate(parser.expression("number(t)"), {"t": text})
        assert n == (None if want is None else float(want) if abs(want) < 10**308 else float("inf") * (1 if want > 0 else -1)), text
    ordered = Engine(spark).load(df, type=F.lit("x"), time=F.lit(0), order="k", unique=True)
    want = sorted((k for k, x in enumerate(texts)), key=lambda k: (evaluate(parser.expression("number(t, 36)"), {"t": texts[k]}) or 0, k))
    assert [x["k"] for x in ordered.raw("x where true | sort number(t, 36)").orderBy("__ord").collect()] == want


def in_base(x, b, kinds):
    n, out = abs(x), ""
    while n:
        n, k = divmod(n, b)
        out = kinds[k] + out
    return "-" * (x < 0) + out
