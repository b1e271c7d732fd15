"""Connected components of a graph of long node ids, by random contraction in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import cut


#: Edges, 16 bytes each, that one task takes to the end; more are contracted before.
AT_ONCE = 1 << 20


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a list of edges, by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    node = np.fromiter(parent, np.int64, len(parent))
    for at in range(0, len(node), 1 << 16):
        part = node[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([find(x) for x in part.tolist()], pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b); nodes are linked as far as edges reach.

    In each round every node moves to the one of itself and its neighbours that a hash, another
    each round, puts first; edges inside a merged group vanish. The expected number of nodes
    falls by a constant factor a round, chains and stars alike. Neighbourhoods are aggregated
    (partly before the shuffle), never collected; rounds are cut by checkpoints. What AT_ONCE bounds ends in one task.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while left.count() > AT_ONCE:
        at = len(moves)
        both = left.union(left.select("b", "a")).toDF("node", "to")
        first = F.min(F.struct(F.xxhash64(F.col("to"), F.lit(at)).alias("h"), F.col("to").alias("to")))
        own = F.struct(F.xxhash64(F.col("node"), F.lit(at)).alias("h"), F.col("node").alias("to"))
        move = cut(both.groupBy("node").agg(first.alias("m")).select("node", F.least("m", own)["to"].alias("root")))
        moves.append(move)
        x = left.join(move.toDF("a", "ra"), "a").join(move.toDF("b", "rb"), "b")
        left = cut(x.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    root = left.coalesce(1).mapInArrow(_united, "node long, root long")
    for move in reversed(moves):
        later = root.toDF("root", "further")
        root = cut(move.join(later, "root", "left").select("node", F.coalesce("further", "root").alias("root")).union(root.join(move, "node", "left_anti")))
    return root
