"""Cutting plans of iterative operators, places that driver and executors share, and what names a row."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.errors import CompileError


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. A temporary one is made if none is set and
    everything runs in this process; on a cluster that is an error."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.isLocal():
            raise CompileError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="wakeline-"))
    return context.getCheckpointDir().get()


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str = "frame") -> DataFrame:
    """df as a Parquet table in the shared folder: later plans start from its files, and read only the columns they need."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _open(x: T.DataType) -> bool:
    """Whether a type holds values that Spark does not hash: VARIANTs and maps."""
    if isinstance(x, (T.VariantType, T.MapType)):
        return True
    if isinstance(x, T.ArrayType):
        return _open(x.elementType)
    return isinstance(x, T.StructType) and any(_open(f.dataType) for f in x.fields)


def body_hash(df: DataFrame, event: str | None = None) -> Column:
    """A hash of all columns (of `event`, a struct of them): it tells apart rows that share a place in the order."""
    names = [(f"{event}.`{f.name}`" if event else f"`{f.name}`", f.dataType) for f in df.schema.fields]
    plain = [F.to_json(F.struct(n)) if _open(t) else F.col(n) for n, t in names if not isinstance(t, T.NullType)]
    return F.xxhash64(*plain)
