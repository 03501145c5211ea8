"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a partially aggregated minimum per node and a join back on the node, so a
node with very many neighbours is no task of its own; the edges are written to the shared
folder after each round.  A map-side union-find (per Arrow batch, bounded) thins the edges
before the first round.  Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch

MAX_ROUNDS = 60
EDGE_SCHEMA = "a long, b long"


class UnionFind:
    """Over 0..n-1; the smaller index is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x > y:
            x, y = y, x
        self.parent[y] = x
        return True


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges (node, smallest node), fewer than nodes."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    uf = UnionFind(len(nodes))
    half = len(a)
    for x, y in zip(index[:half].tolist(), index[half:].tolist()):
        uf.union(x, y)
    root = np.array([uf.find(i) for i in range(len(nodes))], dtype=np.int64)
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _thin(batches):
    for batch in batches:
        if batch.num_rows:
            node, root = star_edges(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and all its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``edges(a long, b long)`` to ``(node long, root long)``: every node of an edge with
    the smallest node of its component (roots map to themselves).  Loops and repeated
    edges do no harm; no edges give an empty table."""
    now = scratch.put(edges.where("a <> b").mapInArrow(_thin, EDGE_SCHEMA).distinct(), f"{name}-0")
    state = None
    for turn in range(1, MAX_ROUNDS):
        ways = F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "ba")])
        both = now.select(F.inline(ways))
        large = _lowest(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        ends = F.array(*[F.struct(F.col(x).alias("a"), F.col("m").alias("b")) for x in ("v", "u")])
        small = _lowest(down).select(F.inline(ends))
        now = scratch.put(small.where("a <> b").distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        seen = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )
