"""The interactive shell: a command a line over one engine and the last results."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from wakeline.api import Config, Engine
from wakeline.errors import QueryError
from wakeline.plans.schema import Schema
from wakeline.sources import sinks

#: Text styles of results, as terminal codes.
STYLES = {"plain": "", "bold": "1", "dim": "2", "red": "31", "green": "32", "yellow": "33", "blue": "34"}


class Shell:
    """configure: makes (Config, definitions) of a file."""

    def __init__(self, engine: Engine, configure: Callable[[str], tuple[Config, str]] | None = None) -> None:
        self.engine, self.configure = engine, configure
        self.last: DataFrame | None = None
        self.display, self.columns, self.style = "json", None, "plain"  # type: tuple[str, list[str] | None, str]
        self.shown = True

    def say(self, text: str) -> None:
        code = STYLES[self.style]
        print(f"\033[{code}m{text}\033[0m" if code and text else text)

    def show(self, display: str, columns: list[str] | None = None) -> None:
        if self.last is None:
            raise ValueError("there are no results; search first")
        rows, n = sinks.json_lines(self.last), 0
        if not self.shown:
            n = self.last.count()
        elif display == "table":
            found = [json.loads(x) for x in rows]
            n = len(found)
            self.say(sinks.table(found, columns))
        else:
            for n, x in enumerate(rows, 1):  # noqa: B007
                self.say(x)
        print(f"{n} result{'' if n == 1 else 's'} found")

    # commands

    def do_input(self, rest: str) -> None:
        """input FILE: the events to search"""
        self.engine.load(rest)

    def do_config(self, rest: str) -> None:
        """config FILE: take a configuration file"""
        if self.configure is None:
            raise ValueError("there is nothing that reads configurations here")
        config, definitions = self.configure(rest)
        self.engine.config = config
        if definitions.strip():
            self.engine.define(definitions)

    def do_schema(self, rest: str) -> None:
        """schema: the types of the input's fields"""
        if self.engine.frame is None:
            raise ValueError("no events were loaded")
        print(Schema.of_frame(self.engine.frame).types)

    def do_search(self, rest: str) -> None:
        """search QUERY: run a query and display its results"""
        self.last = self.engine.run(rest, ordered=True)
        self.show(self.display, self.columns)

    def do_table(self, rest: str) -> None:
        """table [QUERY]: results, or the last ones, as a table"""
        if rest:
            self.last = self.engine.run(rest, ordered=True)
        self.show("table", self.columns)

    def do_display(self, rest: str) -> None:
        """display on|off|json|table [COLUMN, ..]: whether and how results are displayed"""
        word, _, names = rest.partition(" ")
        if word in ("on", "off"):
            self.shown = word == "on"
        elif word in ("json", "table"):
            self.display, self.columns = word, names.replace(",", " ").split() or None
        else:
            raise ValueError("display takes on, off, json or table")

    def do_style(self, rest: str) -> None:
        """style [NAME]: how results are written; without a name, the names"""
        if not rest:
            print(" ".join(STYLES))
        elif rest not in STYLES:
            raise ValueError(f"no style {rest}; there are {', '.join(STYLES)}")
        else:
            self.style = rest

    def do_output(self, rest: str) -> None:
        """output FILE: save the last results as JSON lines, CSV or Parquet"""
        if self.last is None:
            raise ValueError("there are no results; search first")
        sinks.write(self.last, rest)

    def do_clear(self, rest: str) -> None:
        """clear: forget the last results"""
        self.last = None

    def do_shell(self, rest: str) -> None:
        """shell COMMAND: run a command of the system's"""
        done = subprocess.run(rest, shell=True, capture_output=True, text=True, check=False)  # the user's own command line
        print((done.stdout + done.stderr).rstrip("\n"))

    def do_help(self, rest: str) -> None:
        """help [COMMAND]: this list"""
        names = [rest] if rest else sorted(n[3:] for n in dir(self) if n.startswith("do_"))
        for name in names:
            f = getattr(self, f"do_{name}", None)
            print(f.__doc__ if f else f"unknown command {name}")
        if not rest:
            print("quit, exit: leave")

    def run(self, line: str) -> bool:
        """Run a line; whether to go on."""
        command, _, rest = line.strip().partition(" ")
        if command in ("quit", "exit"):
            return False
        if command.startswith("!"):
            command, rest = "shell", line.strip()[1:]
        f = getattr(self, f"do_{command}", None) if command else None
        try:
            if f is not None:
                f(rest.strip())
            elif command:
                print(f"unknown command {command}")
        except (QueryError, ValueError, OSError, AnalysisException) as e:
            print(e)
        return True


def shell(engine: Engine, lines: Iterable[str] | None = None, configure: Any = None) -> int:
    """Run commands of lines, or else of the terminal, until one leaves."""
    it = Shell(engine, configure)
    try:
        for line in lines if lines is not None else iter(lambda: input("wakeline> "), None):
            if not it.run(line):
                break
    except (EOFError, KeyboardInterrupt):
        pass
    return 0
