"""Sources: anything Spark reads, as a frame of events.

A frame has the data's own columns (or one VARIANT column for data without a fixed schema) and
three more: __type, __time (ticks) and __ord, the arrival order that order-sensitive operators
name. Order is never left to the files' accident: it is a column or an expression, or it is made at ingest
from (time, file, position) and written once to the shared folder. Places may be shared: events at
one place are told apart by a hash of their columns. Where places are known to be unique (`unique`, and
any order made here), the column says so in its metadata and no hash is made.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.operators.frames import settle
from wakeline.plans.compiler import DATA

TYPE, TIME, ORD = "__type", "__time", "__ord"
META = (TYPE, TIME, ORD)


def _column(x: str | Column | None) -> Column | None:
    return F.col(x) if isinstance(x, str) else x


def event_type(event_type_: Column, full: Column) -> Column:
    """The type, else the full type without its ending, else generic."""
    return F.coalesce(event_type_, F.regexp_replace(full, "_event$", ""), F.lit("generic"))


UNIQUE = {"unique": True}


def placed(df: DataFrame, time: Column) -> DataFrame:
    """df with __ord, the number of its rows by (time, file, position), written once so that all plans read the same.

    Positions within a file are those of its block and of the row in it. Rows are ranged by time, so no task
    sorts all of them. Frames that have a column to order by need none of this.
    """
    files = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    try:
        x = df.select("*", *[c.alias(f"__p{k}") for k, c in enumerate(files)])
    except AnalysisException:  # no files: rows in memory, or an operator's result
        x = df
    at = [c for c in x.columns if c.startswith("__p") and c not in df.columns]
    x = x.withColumn("__at", F.monotonically_increasing_id()).withColumn("__when", time)
    x = x.sort("__when", *at, "__at").drop("__when", "__at", *at)
    # ids rise with the partition and within it, and sort has ranged the partitions
    x = settle(x.withColumn(ORD, F.monotonically_increasing_id()), "events")
    return x.withColumn(ORD, F.col(ORD).alias(ORD, metadata=UNIQUE))


def from_table(df: DataFrame, type: str | Column | None = None, time: str | Column | None = None, order: str | Column | None = None, unique: bool = False) -> DataFrame:  # noqa: A002
    """A frame of any DataFrame. type, time and order are columns or expressions; by default the columns
    event_type (event_type_full), timestamp and, for the order, time and the position in the files, see placed().
    unique: no two rows share a place in the order given; if that is not so, results are wrong."""
    names = set(df.columns)
    if type is None:
        string = lambda c: F.col(c) if c in names and isinstance(df.schema[c].dataType, T.StringType) else F.lit(None).cast("string")
        kind = event_type(string("event_type"), string("event_type_full"))
    else:
        kind = _column(type)  # type: ignore[assignment]
    if time is None:
        when = F.col("timestamp") if "timestamp" in names else F.lit(0)
        dtype: T.DataType = df.schema["timestamp"].dataType if "timestamp" in names else T.LongType()
    else:
        when = _column(time)  # type: ignore[assignment]
        dtype = df.select(when).schema[0].dataType
    if isinstance(dtype, T.TimestampNTZType):
        when = F.unix_micros(when.cast("timestamp"))
    elif isinstance(dtype, T.TimestampType):
        when = F.unix_micros(when)
    when = F.coalesce(when.cast("bigint"), F.lit(0).cast("bigint"))
    if order is None and not df.isStreaming:
        return placed(df, when).withColumns({TYPE: kind, TIME: when})
    rank = F.monotonically_increasing_id() if order is None else _column(order)
    return df.withColumns({TYPE: kind, TIME: when, ORD: rank.cast("bigint").alias(ORD, metadata=UNIQUE if unique else {})})  # type: ignore[union-attr]


def from_variant(df: DataFrame, data: Column, order: Column | None = None, unique: bool = False) -> DataFrame:
    """A frame of events that are whole VARIANTs; data_buffer is unwrapped. Without an order the events are placed()."""
    buffer = F.try_variant_get(data, "$.data_buffer", "variant")
    whole = F.coalesce(F.when(F.schema_of_variant(buffer).startswith("OBJECT"), buffer), data).alias(DATA)
    d = F.col(DATA)
    when = F.coalesce(F.try_variant_get(d, "$.timestamp", "bigint"), F.lit(0).cast("bigint"))
    x = df.withColumn(DATA, whole)
    x = placed(x, when).select(DATA, ORD) if order is None else x.select(DATA, order.cast("bigint").alias(ORD, metadata=UNIQUE if unique else {}))
    string = lambda p: F.when(F.schema_of_variant(F.try_variant_get(d, p, "variant")) == "STRING", F.try_variant_get(d, p, "string"))
    return x.select(DATA, event_type(string("$.event_type"), string("$.event_type_full")).alias(TYPE), when.alias(TIME), ORD)


def read_json(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Files that each hold one JSON array of events (.json, .json.gz); files without a text, as Spark writes for an empty
    partition, hold none."""
    text = spark.read.text(path, wholetext=True) if encoding is None else _decoded(spark, path, encoding)
    # the reader itself leaves out files of no bytes, but an empty file has some when gzipped; parsed only under the test
    array = F.when(F.col("value").rlike(r"\S"), F.parse_json(F.col("value")))
    each = text.select(F.explode(F.try_variant_get(array, "$", "array<variant>")).alias("e"), F.col("_metadata"))
    return from_variant(each, F.col("e"))


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Whole files in an encoding, through Spark's binary reader; gzip by ending."""
    files = spark.read.format("binaryFile").load(path)
    java = {"utf8": "UTF-8", "utf-8": "UTF-8", "utf16": "UTF-16", "utf-16": "UTF-16", "latin1": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(encoding.lower(), encoding)
    return files.select(F.decode("content", java).alias("value"), F.col("_metadata"))


def read_jsonl(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Files of one event a line (.jsonl, .jsonl.gz); lines without a brace are skipped."""
    if encoding is None:
        text = spark.read.text(path)
    else:
        text = _decoded(spark, path, encoding).select(F.explode(F.split("value", "\r?\n")).alias("value"), F.col("_metadata"))
    event = F.contains("value", F.lit("{"))
    # parsed only under the test, wherever the optimizer moves it
    return from_variant(text.where(event), F.when(event, F.parse_json(F.col("value"))))


def read(spark: SparkSession, path: str, format: str | None = None, encoding: str | None = None, **roles: Any) -> DataFrame:  # noqa: A002
    """A frame of a path, by format or ending: json, jsonl (also .gz), parquet, orc, csv. `-` is stdin."""
    kind = (format or path.rpartition("/")[2].removesuffix(".gz").rpartition(".")[2]).removesuffix(".gz")
    if path == "-":
        return from_lines(spark, sys.stdin, format or "jsonl")
    if kind == "json":
        return read_json(spark, path, encoding)
    if kind in ("jsonl", "ndjson"):
        return read_jsonl(spark, path, encoding)
    if kind == "csv":
        return from_table(spark.read.option("header", True).csv(path), **roles)
    if kind in ("parquet", "orc"):
        return from_table(spark.read.format(kind).load(path), **roles)
    raise ValueError(f"unknown format {kind!r}")


def from_lines(spark: SparkSession, lines: Iterable[str], format: str = "jsonl") -> DataFrame:  # noqa: A002
    """A frame of text at hand: JSON lines, or one JSON array."""
    import json

    texts = [json.dumps(e) for e in json.loads("".join(lines))] if format == "json" else [x for x in lines if "{" in x]
    return from_events(spark, texts)


def from_events(spark: SparkSession, events: Iterable[Mapping[str, Any] | str]) -> DataFrame:
    """A frame of events in memory: dicts, or JSON texts; their order is the arrival order."""
    import json

    rows = [(k, e if isinstance(e, str) else json.dumps(e)) for k, e in enumerate(events)]
    df = spark.createDataFrame(rows, "k long, text string")
    return from_variant(df, F.parse_json(F.col("text")), F.col("k"), unique=True)


def union(*frames: DataFrame) -> DataFrame:
    """Frames of different types as one; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    # frames may share places with each other
    return out.withColumn(ORD, F.col(ORD).alias(ORD, metadata={}))
