"""Quality rules (operator 8): rules on each document, then on its host (its source).

Documents: features of the whole text and two base rules. Hosts: failures are summed by host,
each host's failure rate is shrunk towards the corpus by a beta prior fitted to the hosts'
rates (method of moments), and a host whose shrunk rate passes a threshold rejects its
documents too. Defined results: a null text has no words and so fails; a null host is a host of
its own; repeated rows count as often as they stand; an empty table gives an empty table; keep_good()
keeps all columns (names that start with two underscores are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, cut, small_batches, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is rejected if its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5

_ODD = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that stand in windows of eight words found twice or more in the text."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    with np.errstate(over="ignore"):
        v = sum(h[j : j + m] * _ODD[j] for j in range(WINDOW))
    s = np.sort(v)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.searchsorted(twice, v)
    at[at == len(twice)] = 0
    starts = np.flatnonzero(twice[at] == v)
    cover = np.zeros(n + 1, np.int32)
    cover[starts] += 1
    np.subtract.at(cover, starts + WINDOW, 1)
    return int((np.cumsum(cover[:n]) > 0).sum())


def features(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    white = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    lines = raw.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        full = [x for x in lines if x.strip()]
        dup = len(full) - len(set(full))
    return len(words), len(raw.decode("utf-8", "replace")) - white, sum(raw.count(bytes([c])) for c in SYMBOLS), dup, repeat_words(words)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(x) for x in as_bytes(b.column(2))]
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "host", *FEATURES])


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the features and base_failed of each row of docs; no shuffle."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    found = slim.mapInArrow(_rows, "doc_id long, host string, " + ", ".join(f"{c} long" for c in FEATURES))
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(rules: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_rate (shrunk) and host_rejected, from document_rules().

    The prior: mean m of all documents and the variance s2 of the hosts' rates give
    a + b = m(1-m)/s2 - 1, at least 1 and at most 1e6 (no spread between the hosts).
    """
    by = rules.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    prior = (
        by.agg((F.sum("failed") / F.sum("host_docs")).alias("m"), F.coalesce(F.var_pop(F.col("failed") / F.col("host_docs")), F.lit(0.0)).alias("s2"))
        .withColumn("k", F.when(F.col("s2") <= 0, F.lit(1e6)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.col("m") * (1 - F.col("m")) / F.col("s2") - 1))))
        .select("m", "k")
    )
    one = prior.select(F.struct("m", "k").alias("p")).scalar()
    rate = (F.col("failed") + one["m"] * one["k"]) / (F.col("host_docs") + one["k"])
    return by.select("host", "host_docs", rate.alias("host_rate")).withColumn("host_rejected", F.col("host_rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """document_rules() with host_rate and kept: neither the document nor its host fails.

    Features are computed once and written to the shared folder (a few numbers a row). Failures
    are summed before the shuffle; the join back is on the host, which Spark broadcasts while the
    hosts are few and splits where one host is hot.
    """
    rules = cut(document_rules(docs, id_col, text_col, host_col))
    hosts = host_verdicts(rules, max_rate).withColumnRenamed("host", "verdict_host")
    return rules.join(hosts, F.col("host").eqNullSafe(F.col("verdict_host")), "left").drop("verdict_host").withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("host_rejected"), F.lit(False)))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs, all their columns, that neither their own rules nor their host reject.

    The document's own rules run in the scan that passes the texts on, so texts are not shuffled;
    only the hosts' verdicts, a row for each host, are joined to them.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    ok = "__kept_by_own_rules"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for b in batches:
            good = []
            for x in as_bytes(b.column(at)):
                n, _, _, _, r = features(x)
                good.append(n >= MIN_WORDS and 100 * r <= MAX_REPEAT_PERCENT * n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(good, pa.bool_())], names=[*b.schema.names, ok])

    from pyspark.sql.types import BooleanType, StructType

    bad = host_verdicts(cut(document_rules(docs, id_col, text_col, host_col)), max_rate).where("host_rejected").select(F.col("host").alias("__bad_host"))
    bad = written(bad, "bad-hosts")  # a table whose size is known: broadcast only if it is small
    kept = docs.mapInArrow(rows, StructType([*docs.schema.fields]).add(ok, BooleanType())).where(ok).drop(ok)
    return kept.join(bad, F.col(host_col).cast("string").eqNullSafe(F.col("__bad_host")), "left_anti")
