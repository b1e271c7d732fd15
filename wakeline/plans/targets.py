"""What analytics can be built into: text formats by file ending, to which plugins add their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from wakeline.errors import CompileError
from wakeline.plans import tree as t

if TYPE_CHECKING:
    from wakeline.api import Analytic, Engine


@dataclass(frozen=True)
class Target:
    """convert: the text of one analytic, from it and its checked query. prelude: what stands before all of them."""

    convert: Callable[[Analytic, t.Query], str]
    prelude: Callable[[Engine], str] | None = None


TARGETS: dict[str, Target] = {}


def register(ending: str, prelude: Callable[[Engine], str] | None = None) -> Callable[[Callable[[Analytic, t.Query], str]], Callable[[Analytic, t.Query], str]]:
    """Add a format for files that end so."""

    def add(convert: Callable[[Analytic, t.Query], str]) -> Callable[[Analytic, t.Query], str]:
        TARGETS[ending.lstrip(".")] = Target(convert, prelude)
        return convert

    return add


def render(engine: Engine, analytics: Iterable[Analytic], ending: str, bare: bool = False) -> str:
    """Analytics in a format; bare: without what stands before them. A fault in any of them raises."""
    found = TARGETS.get(ending.lstrip("."))
    if found is None:
        raise CompileError(f"no target for .{ending.lstrip('.')}; there are {', '.join(sorted(TARGETS))}")
    parts = [found.convert(a, engine.parse(a.query)) for a in analytics]
    if found.prelude and not bare:
        parts.insert(0, found.prelude(engine))
    return "\n".join(p.rstrip("\n") for p in parts) + "\n"


@register("txt")
def _text(analytic: Analytic, q: t.Query) -> str:
    """Queries as the rewriter leaves them: macros expanded, constants folded."""
    return f"// {analytic.id}\n{q.text()}\n"


def _job(engine: Engine) -> str:
    c = engine.config
    return f'''"""A Spark job: results of analytics over a file of events, as a Parquet table for each. Arguments: events, results."""

import sys

from pyspark.sql import SparkSession
from wakeline.api import Config, Engine
from wakeline.plans.parser import Dialect

spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
engine = Engine(spark, Config(ticks={c.ticks!r}, case_sensitive={c.case_sensitive!r}, host_key={c.host_key!r}, pid_key={c.pid_key!r}, ppid_key={c.ppid_key!r}, host_partition={c.host_partition!r}, data_source={c.data_source!r}, dialect={c.dialect!r}))
engine.load(sys.argv[1])
'''


@register("py", prelude=_job)
def _python(analytic: Analytic, q: t.Query) -> str:
    """A job of its own. Definitions are expanded in its queries; registered functions must be added by hand."""
    return f"engine.run({q.text()!r}).write.parquet(f'{{sys.argv[2]}}/' + {analytic.id!r})"
