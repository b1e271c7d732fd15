"""Text to nodes and back, what is accepted, what is not and where the fault is shown."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.errors import ParseError, SchemaFault, SemanticFault, SyntaxFault, TypeFault
from wakeline.functions.scalar import Context
from wakeline.plans import introspect, parser
from wakeline.plans import tree as t
from wakeline.plans.compiler import evaluate
from wakeline.plans.macros import Definitions
from wakeline.plans.parser import Dialect
from wakeline.plans.simplify import simplify

STRICT = Dialect(strict=True, allow_negation=True, allow_sample=True, allow_runs=True)
DOLLAR = Dialect(dollar=True)
OPEN = Dialect(implied_any=True, implied_base=True)


@pytest.mark.parametrize("text", [
    "process where true", "any where a == 1 and b != 'x' or not c", "x where a.b[0].c in (1, 2.5, null,)", "x where `odd name`.`b c`[3] == -1", "x where f(a,) == null", "x where AND == 1", "x where a = 1", "x where a not in (b, 1)",
    "x where length(a:substring(1)) > 2 // comment", "x where /* c */ a * 2 + 3 % b >= -c", "x where child of [process where descendant of [file where a == 1]]", 'x where a == "\\u{1f600}\\n\\"" or b == ?"raw\\d" or c == ?\'r\'',
    "sequence [a where true] [b where true]", "sequence by x, y with maxspan=5m [a where true] by z [b where true] by w until [c where true] by v", "sequence with maxspan=500ms [a where true] fork [b where true] | head 1".replace(" fork", "", 1),
    "sequence [a where true] [b where true] fork=true [c where true]", "join by pid [a where true] [b where true] until [c where true]", "a where true | count a.b, c | filter count > 3 | head 5 | tail 2 | sort a b c | unique x | unique_count x y",
    "macro A(x) x == 1 const B = 'b' a where A(y) or z == B", "x where 1.5e3 == .5", "x where a.b == true and null != c",
])
def test_accepted_and_round_trip(text):
    definitions, q = parser.query(text)
    names = Definitions()
    names.add(definitions)
    q = names.expand(q)
    again = parser.query(q.text())[1]
    assert again == q and again.text() == q.text()


@pytest.mark.parametrize("text", [
    "", "process", "process where", "process where a ==", "process where a == 1 b", "process where (a", "process where a in ()", "process where f(", "where true", "process where a b", "any where a == 'x", "any where a == \"\\q\"", "sequence [a where true]", "join [a where true]", "any where a == 1 and", "any where and",
    "any where true | ", "any where true | head |", "x where not", "x where a =! 1", "x where in == 1", "sample by a [x where true] [y where true]", "sequence [a where true] ![b where true] [c where true]", "sequence [a where true] with runs=2 [b where true]", "any where a : 'x'", "any where $a == 1", "any where ?a == 1",
    "sequence [a where true] by x [b where true]", "sequence [a where true] fork=true [b where true]", "sequence [a where true] [b where true] until [c where true] fork", "any where a ==== 1", "x where f~(1)", "sequence with maxspan=5y [a where true] [b where true]", "any where a.in == 1", "any where a[-1] == 1", "const = 1 any where true",
])
def test_rejected(text):
    with pytest.raises(ParseError):
        parser.query(text)


@pytest.mark.parametrize("text, dialect", [
    ("any where a : (\"x*\", \"y\") and b like \"z\" and c like~ \"w\" and d regex~ \"r.*\"", STRICT), ("any where a in~ (1) and f~(?b.c) == 1", STRICT), ('any where a == """raw \\ text"""', STRICT), ("sequence [a where true]", STRICT), ("sequence [a where true] with runs=3 [b where true]", STRICT),
    ("sequence with maxspan=1s [a where true] ![b where true] [c where true]", STRICT), ("sample by h [a where true] [b where true]", STRICT), ("any where arraySearch(a, $x, $x.y == 1)", DOLLAR), ("sequence [a where true] as e1 [b where e1.x == y]", DOLLAR), ("a == 1", OPEN), ("| count", OPEN), ("not a | head", OPEN),
])
def test_dialects_accept(text, dialect):
    parser.query(text, dialect)


@pytest.mark.parametrize("text", ["any where a = 1", "any where a == 'x'", "any where a == ?\"x\"", "join [a where true] ![b where true]", "sequence [a where true] ![b where true] [c where true]", "sequence with maxspan=1s ![a where true] ![b where true]", "sequence [a where true] with runs=1 [b where true]"])
def test_strict_rejects(text):
    with pytest.raises(ParseError):
        parser.query(text, STRICT)


def test_fault_points_at_the_place():
    with pytest.raises(SyntaxFault) as e:
        parser.query("process where\n  a == == 3")
    assert (e.value.line, e.value.column) == (1, 7) and str(e.value).split("\n")[-2:] == ["  a == == 3", "       ^^"]


def test_runs_make_steps():
    assert len(parser.query("sequence [a where true] with runs=3 [b where true]", STRICT)[1].base.steps) == 4


def test_shared_keys_come_first():
    q = parser.query("join by a [x where true] by b [y where true] by c until [z where true] by d")[1].base
    assert [tuple(k.text() for k in s.by) for s in (*q.steps, q.until)] == [("a", "b"), ("a", "c"), ("a", "d")]


def names():
    return st.sampled_from(["a", "b", "c.d", "e[0].f", "`x y`"])


def literals():
    return st.one_of(st.integers(-50, 50), st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 3)), st.text("abXY *%_\\\"\n", max_size=5), st.booleans(), st.none()).map(t.Literal)


def fields():
    return names().map(lambda s: parser.expression(s))


def expressions():
    value = st.one_of(fields(), literals())
    number = st.recursive(st.one_of(fields(), st.integers(-9, 9).map(t.Literal)), lambda x: st.builds(t.Arith, st.sampled_from("+-*/%"), x, x), max_leaves=5)
    test = st.one_of(
        st.builds(t.Compare, st.sampled_from(["==", "!=", "<", "<=", ">", ">="]), number, st.integers(-9, 9).map(t.Literal)),
        st.builds(t.IsNull, fields(), st.booleans()),
        st.builds(t.InSet, value, st.lists(value, min_size=1, max_size=4).map(tuple)),
        st.builds(lambda x, y: t.Call("stringContains", (x, y)), fields(), st.text("abX", max_size=2).map(t.Literal)),
    )
    return st.recursive(test, lambda x: st.one_of(st.builds(t.Not, x), st.lists(x, min_size=2, max_size=3).map(lambda v: t.And(tuple(v))), st.lists(x, min_size=2, max_size=3).map(lambda v: t.Or(tuple(v)))), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(expressions())
def test_text_parses_to_the_same_text(x):
    text = x.text()
    assert parser.expression(text).text() == text


@settings(max_examples=600, deadline=None)
@given(expressions(), st.dictionaries(st.sampled_from("ab"), st.one_of(st.integers(-9, 9), st.sampled_from(["a", "X", "abX"]), st.none(), st.booleans())))
def test_simplify_keeps_the_value(x, event):
    """Sets that exclude each other fold to false and x == x to true even where x is null, so values count where all parts are known."""
    y = simplify(x)
    if all(evaluate(z, event) is not None for z in t.walk(x) if not isinstance(z, t.Literal) or z.value is not None):
        assert evaluate(y, event) == evaluate(x, event)


@pytest.mark.parametrize("text, want", [
    ("1 + 2 * 3 == 7", "true"), ("a == 1 or a == 2 or a == 3", "a in (1, 2, 3)"), ("a in (1, 2) and a in (2, 3)", "a == 2"), ("a in (1, 2, 3) and a != 2", "a in (1, 3)"), ("not not (a == 1)", "a == 1"), ("not a < 3", "a >= 3"), ("not a == null", "a != null"), ("a in (1, 1)", "a == 1"), ("a == a", "true"), ("a != a", "false"),
    ("a + (0 - b)", "a - b"), ("true and a", "a"), ("false or a", "a"), ("true or a", "true"), ("a and false", "false"), ('length("abc") > 2', "true"), ('"A" == "a"', "true"), ('a == "x*" or a == "y*"', 'wildcard(a, "x*", "y*")'), ("a in (1) and a in (2)", "false"), ('"a" in ("A", "b")', "true"), ("null == null", "true"), ("a in (b, a)", "true"),
])
def test_rewrites(text, want):
    assert simplify(parser.expression(text)).text() == want


def test_case_sensitive_folding():
    x = parser.expression('"A" == "a"')
    assert simplify(x, Context(True)) == t.Literal(False)


def test_macros():
    d = Definitions()
    d.add(parser.definitions("const N = 5 macro A(x, y) x.name == y macro B(p) A(p, 'z*') and n > N"))
    q = d.expand(parser.query("any where B(proc) or n == N")[1])
    assert q.base.where.text() == 'wildcard(proc.name, "z*") and n > 5 or n == 5'
    for bad in ("any where A(1)", "any where A(1, 2)"):
        with pytest.raises(SemanticFault):
            d.expand(parser.query(bad)[1])
    with pytest.raises(SemanticFault):
        d.add(parser.definitions("const N = 6"))
    d.custom["twice"] = lambda args: t.Arith("*", args[0], t.Literal(2))
    assert d.expand(parser.expression("twice(a) > 3")).text() == "a * 2 > 3"


def test_introspection():
    q = lambda s: parser.query(s, OPEN)[1]
    assert introspect.query_type(q("sequence [a where true] [b where true]")) == "sequence" and introspect.query_type(q("a where x")) == "event" and introspect.query_type(q("join [a where true] [b where true]")) == "join"
    assert introspect.is_stateful(q("a where x | head")) and not introspect.is_stateful(q("a where x | filter y")) and introspect.is_stateful(q("a where child of [b where true]"))
    assert introspect.uses_ancestry(q("a where child of [b where true]")) and not introspect.uses_ancestry(q("a where b"))
    assert introspect.required_event_types(q("sequence [a where true] [b where event of [c where true]]")) == {"a", "b", "c", "process"}
    assert introspect.output_types(q("sequence [a where true] [b where true]")) == ["a", "b"] and introspect.output_types(q("a where true | count x")) == ["generic"]
    assert introspect.query_terms(q("join [a where x == 1] [b where true]")) == ["a where x == 1", "b where true"]
    assert introspect.match_kv({"a": 1, "b.c": ["x", "y*"]}).text() == 'a == 1 and (wildcard(b.c, "y*") or b.c == "x")'


SCHEMA = {
    "process": {"command_line": "string", "process_name": "string", "pid": "number", "elevated": "boolean", "tags": ["string"], "open": {}, "nest": {"n": "number", "deep": {"b": "boolean"}}, "objects": [{"trusted": "boolean", "n": "number"}]},
    "file": {"file_path": "string", "pid": "number", "data": "mixed"},
}


def check(text, dialect=Dialect(), **flags):
    from wakeline.plans.schema import Checker, Schema

    q = parser.query(text, dialect)[1]
    Checker(text, Schema(SCHEMA, **flags), dialect).query(q)


@pytest.mark.parametrize("text", [
    "process where process_name == 'a' and pid > 3", "file where data == 1 or data == 'x' or data", "any where pid == 1", "process where open.anything.goes[3] == 1", "process where nest.deep.b and elevated", "process where arraySearch(tags, x, x == 'a')", "process where arraySearch(objects, o, o.trusted and o.n > 1)",
    "process where tags[0] == 'x' and length(tags) > 1", "sequence by pid [process where true] [file where true] | filter events[1].file_path == 'x' | unique events[0].pid, file_path".replace(", file_path", ""), "process where true | count pid | filter count > 3 and percent < 0.5 | sort key", "process where true | unique_count pid | filter total_hosts > 1",
    "process where process_name in ('a', null)", "process where null == pid", "process where cidrMatch(process_name, '10.0.0.0/8')", "process where child of [file where pid == 2]", "process where concat(pid, elevated) == 'x'", "process where number(process_name) == 1",
])
def test_schema_accepts(text):
    check(text)


@pytest.mark.parametrize("text, fault", [
    ("network where true", SchemaFault), ("process where nothing == 1", SchemaFault), ("process where file_path == 'x'", SchemaFault), ("process where nest.nope == 1", SchemaFault), ("process where pid == 'x'", TypeFault), ("process where pid", TypeFault), ("process where elevated > true", TypeFault), ("process where tags == 'x'", TypeFault),
    ("process where process_name in (1)", TypeFault), ("process where process_name + 1 == 2", TypeFault), ("process where nope(1)", SemanticFault), ("process where length()", SemanticFault), ("process where length(pid) == 1", TypeFault), ("process where match(process_name, command_line)", SemanticFault), ("process where match(process_name, '(')", SemanticFault),
    ("process where cidrMatch(process_name, '10.0.0.0/40')", SemanticFault), ("process where arraySearch(pid, x, true)", TypeFault), ("process where arraySearch(objects, o, o.nope)", SchemaFault), ("process where true | nope", SemanticFault), ("process where true | head 0", SemanticFault), ("process where true | head pid", SemanticFault),
    ("process where true | unique", SemanticFault), ("process where true | unique 1", SemanticFault), ("process where true | count 'x'", SemanticFault), ("process where true | filter pid", TypeFault), ("sequence by pid [process where true] [file where true] | filter events[2].pid == 1", SchemaFault), ("join by 1 [process where true] [file where true]", SemanticFault),
    ("sequence [process where true] by pid [file where true] by file_path", TypeFault), ("process where true | count pid | filter process_name == 'x'", SchemaFault), ("process where 'a' == process_name and wildcard(process_name)", SemanticFault),
])
def test_schema_rejects(text, fault):
    with pytest.raises(fault):
        check(text)


def test_schema_flags():
    check("process where ?nothing == 1".replace("?", "?"), Dialect(strict=True))
    with pytest.raises(SchemaFault):
        check("process where ?nothing == 1", Dialect(strict=True, validate_optional=True))
    check("process where nothing == 1", allow_missing=True)
    check("generic where nothing == 1", allow_generic=True)
    with pytest.raises(SchemaFault):
        check("any where pid == 1", allow_any=False)
    check("process where process_name.cmd", Dialect(enum_fields=True))
    check("process where pid", Dialect(implied_booleans=True))
    check("process where unknown_function(pid)", Dialect(ignore_missing_functions=True))


def test_schema_learning_and_merging():
    from wakeline.plans.schema import Schema

    s = Schema.learn([("p", {"a": 1, "b": "x", "c": [1, "y"], "d": {"e": True}}), ("p", {"a": "z", "d": {"f": 1}, "g": None}), ("q", {})])
    assert s.types == {"p": {"a": "mixed", "b": "string", "c": ["number", "string"], "d": {"e": "boolean", "f": "number"}, "g": "null"}, "q": {}}
    merged = s.merge(Schema({"p": {"b": "number", "h": "number"}, "r": {"x": "string"}}))
    assert merged.types["p"]["b"] == "string" and merged.types["p"]["h"] == "number" and "r" in merged.types
    assert set(merged.flat()) == {"a", "b", "c", "d", "g", "h", "x"}
    for bad in ({"p": 1}, {"p": {"a": "nope"}}, {"p": {1: "string"}}):
        with pytest.raises(TypeError):
            Schema(bad)
