"""Sources, sinks, analytics, functions, the command line."""

import gzip
import io
import json
import sys

import pytest
from pyspark.sql import functions as F

from wakeline import __main__ as cli
from wakeline import plugins
from wakeline.api import Analytic, Config, Engine, load_analytics, save_analytics
from wakeline.errors import CompileError, QueryError
from wakeline.functions.values import BOOLEAN, NUMBER
from wakeline.plans import targets
from wakeline.plans import tree as t
from wakeline.plans.parser import Dialect
from wakeline.shell import Shell
from wakeline.sources import frames, sinks

EVENTS = [
    {"event_type": "process", "timestamp": 10, "pid": 1, "name": "Ünï.exe", "nest": {"a": [1, "x", {"b": True}]}}, {"event_type_full": "file_event", "timestamp": 20, "pid": 1, "name": "x.txt"}, {"event_type": 4, "event_type_full": "process_event", "pid": 2},
    {"data_buffer": {"event_type": "network", "timestamp": 30, "pid": 2}, "event_type": "outer"}, {"odd": True},
]


def test_types_times_and_buffers(spark):
    got = frames.from_events(spark, EVENTS).orderBy("__ord").collect()
    assert [(r["__type"], r["__time"]) for r in got] == [("process", 10), ("file", 20), ("process", 0), ("network", 30), ("generic", 0)]


def write(path, texts, opener=open, encoding="utf-8"):
    with opener(path, "wb") as f:
        f.write("\n".join(texts).encode(encoding))


@pytest.mark.parametrize("ending, opener", [(".jsonl", open), (".jsonl.gz", gzip.open), (".json", open), (".json.gz", gzip.open)])
def test_json_files(spark, tmp_path, ending, opener):
    path = str(tmp_path / f"e{ending}")
    texts = [json.dumps(EVENTS)] if ".json" == ending[:5] and "jsonl" not in ending else ["", "# no event", *map(json.dumps, EVENTS)]
    write(path, texts, opener)
    e = Engine(spark).load(path)
    assert e.run('process where name == "ünï*" and nest.a[1] == "X" and nest.a[2].b').count() == 1
    assert [r["__type"] for r in e.raw("any where pid == 2").orderBy("__ord").collect()] == ["process", "network"]


@pytest.mark.parametrize("ending, opener", [(".json", open), (".json.gz", gzip.open), (".jsonl.gz", gzip.open)])
def test_files_without_events(spark, tmp_path, ending, opener):
    """An empty file among others holds no events; text that is no JSON is still an error."""
    array = ending.startswith(".json") and "jsonl" not in ending
    for k, texts in enumerate(([""], ["", " "], [json.dumps(EVENTS)] if array else map(json.dumps, EVENTS), ["[]"])):
        write(str(tmp_path / f"e{k}{ending}"), texts, opener)
    assert frames.read(spark, str(tmp_path), ending[1:]).count() == len(EVENTS)
    write(str(tmp_path / f"bad{ending}"), ['[{"event_type": '], opener)
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        frames.read(spark, str(tmp_path), ending[1:]).count()


@pytest.mark.parametrize("encoding", ["utf-16", "latin-1"])
def test_encodings(spark, tmp_path, encoding):
    path = str(tmp_path / "e.jsonl")
    write(path, [json.dumps(x, ensure_ascii=False) for x in EVENTS], encoding=encoding)
    df = frames.read(spark, path, encoding=encoding)
    assert Engine(spark).run('process where name == "ÜNÏ.exe"', df).count() == 1
    write(path, [json.dumps(EVENTS, ensure_ascii=False)], encoding=encoding)
    assert frames.read(spark, path, "json", encoding).count() == len(EVENTS)


def test_tables_and_roles(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT 5 AS id, 'click' AS kind, TIMESTAMP_NTZ '1970-01-01 00:00:01' AS at, CAST(1.5 AS DECIMAL(9, 2)) AS v, DATE '2020-01-02' AS day, map('k', 7) AS m").write.parquet(path)
    e = Engine(spark).load(path, format="parquet", type="kind", time="at", order="id")
    r = e.raw("click where at == 1000000 and v == 1.5 and day == '2020-01-02' and m.k == 7 and m.none == null").collect()
    assert [(x["__ord"], x["__time"]) for x in r] == [(5, 1_000_000)]
    both = frames.union(e.frame, frames.from_table(spark.createDataFrame([(1, "x")], "id long, word string"), F.lit("other"), F.lit(0), "id"))
    assert Engine(spark).run("any where word == 'X' or kind == 'click'", both).count() == 2
    with pytest.raises(ValueError):
        frames.read(spark, "a.xlsx")


def test_sinks(spark, tmp_path):
    e = Engine(spark).load([{"event_type": "a", "timestamp": k, "z": k, "b": [k, {"c": "d"}]} for k in range(4)])
    lines = list(sinks.json_lines(e.raw("a where z > 1").orderBy("__ord")))
    assert lines == [json.dumps({"event_type": "a", "timestamp": k, "z": k, "b": [k, {"c": "d"}]}, sort_keys=True) for k in (2, 3)]
    got = []
    sinks.for_each(e.raw("a where z == 1"), got.append)
    assert got == [{"event_type": "a", "timestamp": 1, "z": 1, "b": [1, {"c": "d"}]}]
    df = spark.createDataFrame([(1, [1, 2], (3, "x"))], "id long, arr array<int>, s struct<a:int,b:string>")
    assert sinks.csv_columns(df).columns == ["id", "arr[0]", "arr[1]", "arr[2]", "s.a", "s.b"]
    for ending in ("csv", "json", "parquet"):
        sinks.write(df, str(tmp_path / f"out.{ending}"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out.csv")).first()["arr[1]"] == "2"
    assert json.loads(spark.read.text(str(tmp_path / "out.json")).first()[0]) == {"id": 1, "arr": [1, 2], "s": {"a": 3, "b": "x"}}
    assert sinks.table([{"a": 1, "b": {"c": ["x", "yy"]}}, {"a": 22}], ["a", "b.c[1]"]) == "a   b.c[1]\n--  ------\n1   yy\n22"


def test_flatten(spark):
    e = Engine(spark, Config(flatten=True)).load([{"event_type": k, "n": n} for n, k in enumerate("aabb")])
    assert [json.loads(x)["n"] for x in sinks.json_lines(e.run("sequence [a where true] [b where true]", ordered=True))] == [1, 2]


def test_analytics(spark, tmp_path):
    analytics = [Analytic("one", "a where n > 0", {"name": "first"}), Analytic("two", "sequence [a where true] [b where true]")]
    for ending in ("json", "toml"):
        path = str(tmp_path / f"a.{ending}")
        save_analytics(analytics, path)
        again = load_analytics(path)
        assert [(a.id, a.query) for a in again] == [(a.id, a.query) for a in analytics] and again[0].metadata["name"] == "first"
    e = Engine(spark).load([{"event_type": k, "n": n} for n, k in enumerate("aabb")])
    got = sorted((r.analytic_id, [json.loads(x)["n"] for x in r.events]) for r in e.analytics(again).collect())
    assert got == [("one", [1]), ("two", [1, 2])]
    with pytest.raises(CompileError):
        e.analytics([])


def test_functions_and_macros(spark):
    e = Engine(spark).load([{"event_type": "a", "n": 2.0, "s": "abc"}, {"event_type": "a", "n": None, "s": "cba"}])
    e.register("back", F.reverse).register("big", lambda x: F.length(x) > 2, BOOLEAN)
    e.register_python("halved", lambda x: x / 2, NUMBER)
    e.define("const WORD = 'CBA' macro IS(x) back(x) == WORD").macro("twice", lambda args: t.Arith("*", args[0], t.Literal(2)))
    assert e.run("a where IS(s)").count() == 1 and e.run("a where twice(halved(n)) == 2").count() == 1 and e.run("a where halved(n) == null").count() == 1
    with pytest.raises(QueryError):
        e.run("a where nope(s)")
    with pytest.raises(CompileError):
        Engine(spark).run("a where true")


def test_enum_words(spark):
    e = Engine(spark).load([{"event_type": "a", "o": {"kind": "create"}}, {"event_type": "a", "o": {"kind": "Create"}}])
    assert e.run("a where o.kind.create").count() == 1


def run(capsys, *args):
    code = cli.main(list(args))
    out = capsys.readouterr()
    return code, out.out.splitlines(), out.err


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    path = str(tmp_path / "e.jsonl")
    write(path, [json.dumps({"event_type": k, "timestamp": n, "n": n, "host": f"h{n % 2}"}) for n, k in enumerate("aabbab")])
    code, out, _ = run(capsys, "query", "a where n > 0", "-f", path)
    assert code == 0 and [json.loads(x)["n"] for x in out] == [1, 4]
    assert [json.loads(x)["n"] for x in run(capsys, "query", "sequence [a where true] [b where true]", "-f", path)[1]] == [1, 2, 4, 5]
    assert [json.loads(x) for x in run(capsys, "query", "| count event_type", "-f", path)[1]] == [{"count": 3, "key": "a", "percent": 0.5}, {"count": 3, "key": "b", "percent": 0.5}]
    assert run(capsys, "query", "a where ==", "-f", path)[0] == 2
    config = str(tmp_path / "c.json")
    (tmp_path / "c.json").write_text(json.dumps({"definitions": "const N = 3", "host_key": "host", "schema": {"a": {"n": "number"}, "b": {"n": "number"}}}))
    assert len(run(capsys, "query", "any where n >= N", "-c", config, "-f", path)[1]) == 3
    code, _, err = run(capsys, "query", "any where m == 1", "-c", config, "-f", path)
    assert code == 2 and "Unknown field m" in err
    monkeypatch.setattr("sys.stdin", io.StringIO('{"event_type": "x", "n": 1}\nno event\n{"event_type": "y"}\n'))
    assert [json.loads(x)["event_type"] for x in run(capsys, "query", "any where n == null")[1]] == ["y"]
    assert run(capsys, "optimize", "1 + 1 == 2 and not a == 3")[1] == ["a != 3"]
    assert run(capsys, "optimize", "sequence [a where true and b] [c where d]")[1] == ["sequence", "  [a where b]", "  [c where d]"]
    assert run(capsys, "check", "a where (")[0] == 2 and run(capsys, "check", "a where b")[0] == 0
    save_analytics([Analytic("one", "a where n > 0")], str(tmp_path / "in1.json"))
    save_analytics([Analytic("two", "b where n > 0")], str(tmp_path / "in2.json"))
    assert run(capsys, "build", str(tmp_path / "in*.json"), str(tmp_path / "out.toml"))[0] == 0
    assert [a.id for a in load_analytics(str(tmp_path / "out.toml"))] == ["one", "two"]


def test_shell(spark, tmp_path, capsys):
    path = str(tmp_path / "e.jsonl")
    write(path, [json.dumps({"event_type": k, "n": n}) for n, k in enumerate("ab")])
    out = str(tmp_path / "saved.json")
    cli.shell(Engine(spark), iter([f"input {path}", "schema", "search a where n == 0", "table any where true", f"output {out}", "search a where ==", "nonsense", "clear", "quit", "search never"]))
    text = capsys.readouterr().out
    assert "'event_type': 'string'" in text and '{"event_type": "a", "n": 0}' in text and "event_type  n" in text and "Invalid syntax" in text and "unknown command" in text
    assert spark.read.text(out).count() == 2


def test_shell_commands(spark, tmp_path, capsys):
    path, config, out = str(tmp_path / "e.jsonl"), tmp_path / "c.json", str(tmp_path / "saved.csv")
    write(path, [json.dumps({"event_type": k, "n": n}) for n, k in enumerate("ab")])
    config.write_text(json.dumps({"definitions": "const TOP = 1", "case_sensitive": True}))

    def say(*lines):
        it = Shell(Engine(spark).load(path), cli.config_of)
        assert all(it.run(x) for x in lines)
        return capsys.readouterr().out

    text = say(f"config {config}", "search any where n == TOP", "search A where true", "search any where event_type == 'A'", f"config {tmp_path}/none.json")
    assert '{"event_type": "b", "n": 1}' in text and "1 result found" in text and text.count("0 results found") == 2 and "No such file" in text
    text = say("display off", "search any where true", "display on", "display table n", "search a where true", "table", "display nonsense")
    assert text.splitlines()[0] == "2 results found" and text.splitlines()[1:4] == ["n", "-", "0"] and "display takes" in text
    assert "\033[32m" in say("style green", "search a where true") and "plain" in say("style") and "no style" in say("style loud")
    assert say("shell echo one", "!echo two").splitlines() == ["one", "two"]
    assert "search QUERY" in say("help") and "unknown command nope" in say("help nope") and say("") == ""
    assert "no results" in say(f"output {out}") and "no results" in say("table")
    say("search any where true", f"output {out}")
    assert spark.read.option("header", True).csv(out).count() == 2
    it = Shell(Engine(spark))
    assert not it.run("exit") and it.run("schema") and it.run("config x") and it.run("search any where true")
    assert capsys.readouterr().out.count("\n") == 3


def test_targets(spark, tmp_path, capsys):
    source = str(tmp_path / "in.json")
    save_analytics([Analytic("one", "a where n == 1 + 1"), Analytic("two", "sequence [a where true] [b where not n == 0]")], source)
    assert run(capsys, "build", source, str(tmp_path / "all.txt"))[0] == 0
    assert (tmp_path / "all.txt").read_text() == "// one\na where n == 2\n// two\nsequence\n  [a where true]\n  [b where n != 0]\n"
    assert run(capsys, "build", source, str(tmp_path / "job.py"))[0] == 0 and run(capsys, "build", "--bare", source, str(tmp_path / "bare.py"))[0] == 0
    path, text = str(tmp_path / "e.jsonl"), (tmp_path / "job.py").read_text()
    write(path, [json.dumps({"event_type": k, "n": 2}) for k in "ab"])
    assert "SparkSession" not in (tmp_path / "bare.py").read_text()
    sys.argv, old = ["job.py", path, str(tmp_path / "results")], sys.argv
    try:
        exec(compile(text, "job.py", "exec"), {})
    finally:
        sys.argv = old
    assert spark.read.parquet(str(tmp_path / "results" / "one")).count() == 1 and spark.read.parquet(str(tmp_path / "results" / "two")).count() == 1
    code, _, err = run(capsys, "build", source, str(tmp_path / "all.nope"))
    assert code == 2 and "no target" in err
    save_analytics([Analytic("bad", "a where ==")], source)
    assert run(capsys, "build", source, str(tmp_path / "bad.txt"))[0] == 2 and not (tmp_path / "bad.txt").exists()


def test_plugins(tmp_path, monkeypatch, capsys):
    (tmp_path / "wakeline_shout.py").write_text("from wakeline.plans import targets\n\n@targets.register('.loud')\ndef loud(analytic, q):\n    return q.text().upper()\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert plugins.load(force=True) == ["wakeline_shout"] == plugins.load()
    save_analytics([Analytic("one", "a where n")], str(tmp_path / "in.json"))
    assert run(capsys, "build", str(tmp_path / "in.json"), str(tmp_path / "out.loud"))[0] == 0
    assert (tmp_path / "out.loud").read_text() == "A WHERE N\n"
    del targets.TARGETS["loud"]


def test_dialect_from_configuration(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dialect": {"strict": True}, "time_unit": 1000}))
    config, _ = cli.config_of(str(tmp_path / "c.json"))
    assert config.dialect == Dialect(strict=True, implied_any=True, implied_base=True) and config.ticks == 1000
