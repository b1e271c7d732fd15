"""Sinks: sorted JSON lines, files, callbacks, flattened matches, plain tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.plans.compiler import DATA
from wakeline.sources.frames import META


def flatten(df: DataFrame) -> DataFrame:
    """Each event of each match as a row of its own, in order: __match, __pos and the event's columns."""
    if "events" not in df.columns:
        return df
    keep = [c for c in ("analytic_id",) if c in df.columns]
    rank = F.col("__ord") if "__ord" in df.columns else F.monotonically_increasing_id()
    x = df.select(*keep, rank.alias("__match"), F.posexplode("events").alias("__pos", "e"))
    return x.select("__match", "__pos", *keep, "e.*")


def as_json(df: DataFrame) -> Column:
    """A row as JSON: own columns by name, or the VARIANT as it came."""
    names = sorted(c for c in df.columns if not c.startswith("__"))
    if DATA in df.columns and not names:
        return F.to_json(F.col(DATA))
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))


def json_lines(df: DataFrame) -> Iterator[str]:
    """Rows as JSON texts with sorted keys, a partition in the driver at a time."""
    for row in df.select(as_json(df).alias("j")).toLocalIterator():
        yield json.dumps(json.loads(row.j), sort_keys=True)


def for_each(df: DataFrame, hook: Callable[[dict[str, Any]], None]) -> None:
    """Call hook with each result, as a dict."""
    for text in json_lines(df):
        hook(json.loads(text))


def csv_columns(df: DataFrame, most: int = 3) -> DataFrame:
    """Columns that a CSV file can hold: objects as a.b, arrays as a[0] .. up to `most`, else as JSON."""
    out: list[Column] = []

    def add(col: Column, dtype: T.DataType, name: str) -> None:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                add(col.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name)
        elif isinstance(dtype, T.ArrayType):
            for k in range(most):
                add(F.get(col, F.lit(k)), dtype.elementType, f"{name}[{k}]")
        elif isinstance(dtype, (T.MapType, T.VariantType)):
            out.append(F.to_json(col).alias(name))
        else:
            out.append(col.alias(name))

    for f in df.schema.fields:
        if f.name not in META:
            add(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def write(df: DataFrame, path: str, format: str | None = None) -> None:  # noqa: A002
    """Save results as json (lines), parquet or csv, by format or ending."""
    kind = format or path.rpartition(".")[2]
    if kind == "csv":
        csv_columns(df).write.option("header", True).csv(path)
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        df.select(as_json(df).alias("value")).write.text(path)


def table(rows: list[dict[str, Any]], columns: list[str] | None = None) -> str:
    """Rows as an aligned text table; columns may be dotted paths with places."""
    import re

    def get(row: Any, path: str) -> Any:
        for p in re.findall(r"[^.\[\]]+", path):
            row = row.get(p) if isinstance(row, dict) else row[int(p)] if isinstance(row, list) and p.isdigit() and int(p) < len(row) else None
        return row

    names = columns or sorted({k for r in rows for k in r})
    cells = [[("" if (x := get(r, c)) is None else x if isinstance(x, str) else json.dumps(x)) for c in names] for r in rows]
    widths = [max(map(len, column)) for column in zip(names, *cells, strict=True)] if names else []
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, widths, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in widths]), *map(line, cells)])
