"""Command line: query, optimize, check, build, shell. Plugins are loaded first."""

from __future__ import annotations

import argparse
import glob
import sys
from collections.abc import Sequence
from typing import Any

from wakeline import __version__, plugins
from wakeline.api import Config, Engine, load_analytics, load_file, save_analytics
from wakeline.errors import CompileError, ParseError, QueryError
from wakeline.plans import targets
from wakeline.plans.parser import Dialect
from wakeline.plans.schema import Schema
from wakeline.shell import shell

FORMATS = ("json", "toml", "yaml", "yml")


def session() -> Any:
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("wakeline").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def config_of(path: str | None) -> tuple[Config, str]:
    """A configuration file: keys of Config, schema, definitions, definitions_files."""
    data = load_file(path) if path else {}
    definitions = [data.pop("definitions", "")] + [open(p, encoding="utf-8").read() for p in data.pop("definitions_files", [])]
    schema = Schema(data.pop("schema", {}))
    if "time_unit" in data:
        data["ticks"] = data.pop("time_unit")
    dialect = Dialect(**({"implied_any": True, "implied_base": True} | data.pop("dialect", {})))
    known = {k: v for k, v in data.items() if k in Config.__dataclass_fields__}
    return Config(schema=schema, dialect=dialect, **known), "\n".join(definitions)


def engine_of(args: argparse.Namespace, spark: Any) -> Engine:
    config, definitions = config_of(args.config)
    engine = Engine(spark, config)
    return engine.define(definitions) if definitions.strip() else engine


def optimized(engine: Engine, text: str) -> str:
    """An expression, or else a query, as the rewriter leaves it."""
    try:
        return engine.parse_expression(text).text()
    except ParseError:
        return engine.parse(text).text()


def build(engine: Engine, source: str, target: str, bare: bool = False) -> None:
    """Check analytics (a file or a glob of files) and write them as one file: in a format of analytics, or in that of the
    target registered for its ending."""
    found = [a for path in sorted(glob.glob(source)) or [source] for a in load_analytics(path)]
    ending = target.rpartition(".")[2]
    if ending in targets.TARGETS:
        text = targets.render(engine, found, ending, bare)
        with open(target, "w", encoding="utf-8") as f:
            f.write(text)
        return
    if ending not in FORMATS:
        raise CompileError(f"no target for .{ending}; there are {', '.join(sorted([*FORMATS, *targets.TARGETS]))}")
    for a in found:
        engine.parse(a.query)
    save_analytics(found, target)


def main(argv: Sequence[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="wakeline")
    top.add_argument("-V", "--version", action="version", version=f"wakeline {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build")
    p.add_argument("-c", "--config")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--bare", action="store_true", help="without what the target puts before analytics")
    for name in ("query", "optimize", "check", "shell"):
        p = sub.add_parser(name)
        p.add_argument("-c", "--config")
        if name != "shell":
            p.add_argument("text")
        if name in ("query", "shell"):
            p.add_argument("-f", "--file", default="-" if name == "query" else None)
            p.add_argument("--format", choices=["json", "jsonl", "json.gz", "jsonl.gz", "parquet", "orc", "csv"])
            p.add_argument("--encoding")
    args = top.parse_args(argv)
    plugins.load()
    try:
        if args.command in ("optimize", "check"):
            engine = engine_of(args, None)
            if args.command == "optimize":
                print(optimized(engine, args.text))
            else:
                engine.parse(args.text)
            return 0
        if args.command == "build":
            build(engine_of(args, None), args.source, args.target, args.bare)
            return 0
        from wakeline.sources import frames, sinks

        engine = engine_of(args, session())
        if args.command == "shell":
            if args.file:
                engine.load(args.file)
            return shell(engine, configure=lambda path: config_of(path))
        engine.parse(args.text)  # faults in the text come before any reading
        engine.frame = frames.read(engine.spark, args.file, args.format, args.encoding)
        got = engine.raw(args.text)
        got = sinks.flatten(got).orderBy("__match", "__pos") if "events" in got.columns else got.orderBy("__ord")
        for line in sinks.json_lines(got):
            print(line)
        return 0
    except QueryError as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
