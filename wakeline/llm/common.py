"""What several operators share: the shared folder, byte columns of Arrow batches, packed blobs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:  # of the C library, where it is glibc
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _TRIM = None

#: White space that separates words in every contract: space and \t \n \v \f \r.
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one made here where all runs in this
    process (tests). On a cluster that has none it raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = have.get() if have.isDefined() else None
    if not found:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wakeline-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: later plans start from those files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: compressed, columnar, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows of docs and the bytes of their texts."""
    r = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("b")).first()
    return r.n, r.b


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session; packed stages use it as their number of buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession, rows: int = 2000, bytes_: str = "16m") -> None:
    """Bound the Arrow batches sent to Python: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_)


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in text (null: 0), counted by splitting, without lists of matches."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.size(F.split(t, "[ \\t\\n\\x0B\\f\\r]+", -1))
    lead = t.rlike("^[ \\t\\n\\x0B\\f\\r]").cast("int")
    tail = t.rlike("[ \\t\\n\\x0B\\f\\r]\\z").cast("int")
    return F.when(t == "", F.lit(0)).otherwise(pieces - lead - tail).cast("long")


def release() -> None:
    """Give memory that is free back to the system: Python workers are used again by later stages, and keep what they
    once took. Called where a task's part begins, when the part before it is freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed blob, byte planes apart so that high zero bytes vanish."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(n, a.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of pack(), given their dtypes."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
