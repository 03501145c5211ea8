"""Exact top-k inner-product search with one KD-tree per shard.

Vectors are dealt over shards of about ``SHARD_ROWS`` rows by a hash of their row number.  In a
shard a KD-tree splits at the median of the widest dimension down to leaves of ``LEAF`` rows;
every node keeps the tight bounding box of its rows.  The largest inner product that a
query can have with a row of a box is the sum over dimensions of the larger of
``q * low`` and ``q * high``; nodes are taken best first, and the search of a shard ends
when the best bound left is below the query's k-th score.  Queries first search one shard;
the k-th score found there is propagated as the starting bound for all other shards.

Queries come in blocks of ``QUERY_BLOCK``; a task holds one shard and one block.  Components
become floor(256 * x) in double precision, scores are integers, ties go to the smaller id.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows
with a null id, take no part; vectors of different lengths do not meet; of rows with a repeated
id each asks for itself, and only the asking row itself is never its answer; components and scores
beyond 64 bits count as the largest (smallest) such integer, smaller ones are exact;
with fewer candidates than k all are returned; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch

TOP = 5
SHARD_ROWS = 8192
LEAF = 128
QUERY_BLOCK = 8192
EXACT_DOUBLE = 2.0**52  # sums of integers below this size are exact in doubles
EXACT_LONG = 2.0**62
ROUNDING = 1e-9  # far above the relative error of a sum of doubles
LARGEST = 2**63 - 1


class KDTree:
    """Rows in tree order with, per node, its row range, children and tight box."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(rows))
        self.ranges, self.children, self.low, self.high = [], [], [], []
        stack = [(0, len(rows), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            part = rows[self.order[lo:hi]]
            low, high = part.min(axis=0), part.max(axis=0)
            number = len(self.ranges)
            self.ranges.append((lo, hi))
            self.children.append([])
            self.low.append(low)
            self.high.append(high)
            if parent >= 0:
                self.children[parent].append(number)
            wide = int((high - low).argmax())
            if hi - lo > leaf and high[wide] > low[wide]:
                middle = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, wide], middle)]
                stack += [(lo, lo + middle, number), (lo + middle, hi, number)]
        self.rows = rows[self.order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.peak = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))  # by node and dimension

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, nodes): no row of the node scores more."""
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        most = up @ self.high.T.astype(float) + down @ self.low.T.astype(float)
        sizes = np.abs(queries.astype(float)) @ self.peak.T  # doubles round sums of such size
        return np.maximum(np.where(sizes < EXACT_DOUBLE, most, most + sizes * ROUNDING), -float(LARGEST))

    def scores(self, lo: int, hi: int, query: np.ndarray) -> np.ndarray:
        """Inner products of ``query`` with rows ``lo`` to ``hi``; in Python integers where 64 bits might not do."""
        if float(np.abs(query.astype(float)) @ self.peak[0]) < EXACT_LONG:
            return self.rows[lo:hi] @ query
        exact = self.rows[lo:hi].astype(object) @ query.astype(object)
        return np.array([min(max(s, -LARGEST - 1), LARGEST) for s in exact], dtype=np.int64)

    def search(self, query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int, least: int | None):
        """The k best (score, id) of this tree, at least ``least``, without the row ``own``; ``ids`` and ``rows``
        (the number of each row in the table) in tree order."""
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        todo = [(-bound[0], 0)]
        while todo:
            most, node = heapq.heappop(todo)
            kth = best[0][0] if len(best) == k else least
            if kth is not None and -most < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(todo, (-bound[child], child))
                continue
            lo, hi = self.ranges[node]
            scores = self.scores(lo, hi, query)
            if kth is not None:
                near = np.flatnonzero(scores >= kth)
            else:
                near = np.arange(hi - lo)
            for j in near.tolist():
                if rows[lo + j] == own:
                    continue
                entry = (int(scores[j]), -int(ids[lo + j]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(score, -minus) for score, minus in best]


_HITS = "row long, query_id long, vec_id long, score long"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search_tile(k: int):
    def run(key, rows, queries):
        out: dict[str, list] = {name: [] for name in ("row", "query_id", "vec_id", "score")}
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("row")
            queries = queries.sort_by("row")
            tree = KDTree(_matrix(rows.column("v")))
            ids = rows.column("id").to_numpy()[tree.order]
            numbers = rows.column("row").to_numpy()[tree.order]
            asked = _matrix(queries.column("v"))
            bounds = tree.bounds(asked)
            for i, query in enumerate(queries.select(["row", "id", "least"]).to_pylist()):
                for score, vec in tree.search(asked[i], query["row"], ids, numbers, bounds[i], k, query["least"]):
                    for name, value in zip(out, (query["row"], query["id"], vec, score)):
                        out[name].append(value)
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def top_k(
    vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` for the rows where ``is_query``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "kdtree")
    sound = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("raw"), is_query.alias("asks")
    ).where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)) & (F.size("raw") > 0))
    rows = rows.select("id", F.transform("raw", lambda x: F.floor(x * 256.0)).alias("v"), "asks")
    rows = rows.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()})
    rows = scratch.put(rows, "rows")  # written, so a row keeps its number
    count, asking = rows.agg(F.count("id"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0))).first()
    shards = max(1, -(-count // SHARD_ROWS))
    blocks = max(1, -(-asking // QUERY_BLOCK))

    stored = rows.select("dim", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "id", "v")
    queries = rows.where("asks").select("dim", "row", "id", "v")
    queries = scratch.put(queries.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks))), "queries")
    all_blocks = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    all_shards = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    home = F.pmod(F.col("block"), F.lit(shards))
    tile = ["dim", "shard", "block"]

    def run(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_search_tile(k), _HITS)

    at_home = F.pmod(F.col("block"), F.lit(shards)) == F.col("shard")
    spread = stored.withColumn("block", F.explode(all_blocks))
    first = scratch.put(
        run(spread.where(at_home), queries.withColumn("shard", home).withColumn("least", F.lit(None).cast("long"))), "first"
    )
    kth = first.groupBy("row").agg(F.count("score").alias("n"), F.min("score").alias("least"))
    kth = kth.select("row", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    later = queries.join(kth, "row", "left").withColumn("shard", F.explode(all_shards)).where(~at_home)
    rest = run(spread.where(~at_home), later)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    hits = first.union(rest) if shards > 1 else first
    return (
        hits.withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
