"""Embedding near-dedup: links between vectors of one label with cosine >= ``MIN_COSINE``, by
product quantisation.

Equal vectors of a label are one class (counted, not paired).  Unit vectors go to coarse
inverted lists (nearest of k centroids); each stored vector keeps the codes of its
residual in ``PARTS`` subspaces and the norm of its quantisation error.  A query probes every
list that can hold a partner: a unit vector within distance d of the query lies in another
cell only if the query is within d of the bisecting plane of the two centroids, so probing
those lists loses nothing.  In a list, asymmetric distances (query against codes, by table
lookup) plus the stored error pick the candidates; by the triangle inequality a partner is
never missed.  The candidates are reranked by the exact cosine in double precision.

Centroids and codebooks are fitted on at most about ``FIT_ROWS`` vectors (a documented sample;
it changes the cost, not the result); every vector is indexed.  Lists are cut into blocks
of ``BLOCK`` rows and every pair of blocks is a task of its own, so a list that holds a third of
all vectors is many tasks.  A task returns link counts per class and a spanning forest, never all
pairs.  The number of lists grows with the vectors up to ``MAX_LISTS``; beyond that the lists
grow.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing; vectors of different lengths are not compared; rows
with a null id take no part and get a null component; floats stay floats and everything else is read as doubles,
of any finite size; rows repeating an id are vectors
of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.llm.components import components, star_edges
from trawl.llm.scratch import Scratch

MIN_COSINE = 0.98
FIT_ROWS = 20_000
ROWS_PER_LIST = 1_000
MAX_LISTS = 1_024
PARTS = 8
CODEWORDS = 64
ROUNDS = 8
BLOCK = 1024
SEED = 11
#: Bounds of what a task computes at once: rows placed, distances, exact cosines.
PLACE_ROWS = 2048
PAIRS_AT_ONCE = 1 << 20
RERANK_AT_ONCE = 1 << 16
#: Slack for rounding in the candidate tests (never in the rerank).
SLACK = 1e-6


def _valid(vector: str, label: str):
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.col(label).isNotNull()
        & F.col(vector).isNotNull()
        & F.coalesce(sound, F.lit(False))
        & F.exists(vector, lambda x: x != 0)
    )


def _matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small doubles would leave their range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (((centers**2).sum(1) - 2 * x @ centers.T)).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centers)
        counts = np.bincount(near, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return centers


def _split(x: np.ndarray) -> np.ndarray:
    """(n, d) to (PARTS, n, ceil(d / PARTS)), filled up with zeros."""
    width = -(-x.shape[1] // PARTS)
    x = np.pad(x, ((0, 0), (0, width * PARTS - x.shape[1])))
    return x.reshape(len(x), PARTS, width).transpose(1, 0, 2)


class Quantizer:
    """Coarse centroids and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(SEED)
        x = _unit(sample)
        self.centers = _kmeans(x, lists, rng)
        rest = _split(x - self.centers[_nearest(x, self.centers)])
        self.books = [_kmeans(part, CODEWORDS, rng) for part in rest]
        square = (self.centers**2).sum(1)
        gaps = square[:, None] + square[None, :] - 2 * self.centers @ self.centers.T
        self.gaps = np.sqrt(np.maximum(gaps, 0))

    def encode(self, x: np.ndarray):
        """List, codes and error norm of unit vectors."""
        near = _nearest(x, self.centers)
        rest = _split(x - self.centers[near])
        codes = np.stack([_nearest(part, book) for part, book in zip(rest, self.books)], axis=1).astype(np.uint8)
        back = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)])
        return near, codes, np.sqrt(((rest - back) ** 2).sum(axis=(0, 2)))

    def probes(self, x: np.ndarray, near: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the later lists that can hold a vector within ``reach`` of a row (a
        pair of lists is looked at from the earlier one)."""
        far = (self.centers**2).sum(1)[None, :] - 2 * x @ self.centers.T
        far -= far[np.arange(len(x)), near][:, None]
        hit = far <= 2 * reach * self.gaps[near] + SLACK
        return np.nonzero(hit & (np.arange(len(self.centers))[None, :] > near[:, None]))

    def distances(self, queries: np.ndarray, center: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the stored codes of a list, by table lookup."""
        total = np.zeros((len(queries), len(codes)))
        for m, (rest, book) in enumerate(zip(_split(queries - self.centers[center]), self.books)):
            table = (rest**2).sum(1)[:, None] - 2 * rest @ book.T + (book**2).sum(1)[None, :]
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


_PLACED = "label string, dim int, list int, stored boolean, id long, n long, vector {array}, codes binary, err double"


def _place(shared, reach: float):
    """Each class as a stored row of its list and as a query of the later lists it probes."""

    def run(batches):
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for dim in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == dim)
                quantizer = shared.value[dim]
                for lo in range(0, len(mine), PLACE_ROWS):
                    part = batch.take(pa.array(mine[lo : lo + PLACE_ROWS]))
                    x = _unit(_matrix(part.column(3)))
                    near, codes, err = quantizer.encode(x)
                    asking, asked = quantizer.probes(x, near, reach)
                    row = np.concatenate([np.arange(len(x)), asking])
                    stored = np.arange(len(row)) < len(x)
                    taken = part.take(pa.array(row))
                    none = [None] * len(asking)
                    columns = [
                        taken.column(0),
                        pa.array(np.full(len(row), dim, np.int32)),
                        pa.array(np.concatenate([near, asked]).astype(np.int32)),
                        pa.array(stored),
                        taken.column(1),
                        taken.column(2),
                        taken.column(3),
                        pa.array([c.tobytes() for c in codes] + none, pa.binary()),
                        pa.array(err.tolist() + none, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _PLACED.split(", ")])

    return run


_FOUND = "kind int, a long, b long"


def _compare(shared, min_cosine: float, reach: float):
    def run(key, table):
        table = table.sort_by("id")
        stored = np.array(table.column("side").to_pylist())
        if not (stored == 0).any() or table.num_rows < 2:
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        quantizer = shared.value[table.column("dim")[0].as_py()]
        center = table.column("list")[0].as_py()
        within = bool(table.column("within")[0].as_py())
        x = _unit(_matrix(table.column("vector")))
        ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
        right = np.flatnonzero(stored == 0)
        # a diagonal tile has one side and pairs it with itself
        left = np.flatnonzero(stored == 1) if (stored == 1).any() else (right if within else np.array([], np.int64))
        diagonal = left is right
        codes = np.stack([np.frombuffer(table.column("codes")[i].as_py(), np.uint8) for i in right.tolist()])
        err = np.array([table.column("err")[i].as_py() for i in right.tolist()])
        y = x[right]
        links = np.zeros(len(ids), np.int64)
        pairs = []
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for lo in range(0, len(left), step):
            some = left[lo : lo + step]
            near = quantizer.distances(x[some], center, codes) <= reach + err[None, :] + SLACK
            if diagonal:
                near &= right[None, :] > some[:, None]
            q, t = np.nonzero(near)
            for at in range(0, len(q), RERANK_AT_ONCE):
                i, j = some[q[at : at + RERANK_AT_ONCE]], t[at : at + RERANK_AT_ONCE]
                same = np.einsum("ij,ij->i", x[i], y[j]) >= min_cosine
                i, j = i[same], right[j[same]]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                pairs.append(star_edges(ids[i], ids[j]))
        forest = list(zip(*star_edges(*(np.concatenate(side) for side in zip(*pairs))))) if pairs else []
        some = np.flatnonzero(links)
        a = [*ids[some].tolist(), *(int(p) for p, _ in forest)]
        b = [*links[some].tolist(), *(int(q) for _, q in forest)]
        kind = [0] * len(some) + [1] * len(forest)
        return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """One row per input row: ``key``, ``n_links``, ``component_id``, ``kept``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    reach = math.sqrt(max(0.0, 2 - 2 * min_cosine))
    ok = F.col("id").isNotNull() & _valid("v", "y")
    given = vectors.select(vector).schema[0].dataType
    array = "array<float>" if isinstance(getattr(given, "elementType", None), T.FloatType) else "array<double>"
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast(array).alias("v"), F.col(label).cast("string").alias("y")
    )
    rows = rows.withColumns({"c1": F.when(ok, F.xxhash64("y", "v")), "c2": F.when(ok, F.xxhash64(F.lit(SEED), "v", "y"))})
    classes = scratch.put(
        rows.where("c1 is not null").groupBy("c1", "c2")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("y").alias("label"), F.first("v").alias("vector"))
        .withColumn("dim", F.size("vector")),
        "classes",
    )

    quantizers = {}
    unit = F.pmod(F.xxhash64(F.lit(SEED), "c1"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    for dim, n in classes.groupBy("dim").agg(F.count(F.lit(1))).collect():
        sample = classes.where((F.col("dim") == dim) & (unit < F.lit(FIT_ROWS / n))).select("vector", "c1", "c2")
        got = sample.orderBy("c1", "c2").limit(2 * FIT_ROWS).toArrow()
        if got.num_rows == 0:
            got = classes.where(F.col("dim") == dim).orderBy("c1", "c2").select("vector").limit(1).toArrow()
        quantizers[dim] = Quantizer(_matrix(got.column("vector")), max(1, min(MAX_LISTS, -(-n // ROWS_PER_LIST))))
    shared = spark.sparkContext.broadcast(quantizers)

    # nodes are numbered by class hash, not by id: ids may repeat
    slim = classes.select("label", F.col("c1").alias("id"), "n", "vector", "dim")
    placed = scratch.put(slim.mapInArrow(_place(shared, reach), _PLACED.format(array=array)), "placed")
    group = ["label", "dim", "list"]
    blocks = placed.groupBy(*group).agg(
        F.ceil(F.sum(F.col("stored").cast("int")) / BLOCK).alias("nb"),
        F.ceil(F.sum((~F.col("stored")).cast("int")) / BLOCK).alias("qb"),
    )
    dealt = placed.join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, group)
    i = F.when(F.col("stored"), F.pmod(F.xxhash64("id"), F.greatest("nb", F.lit(1)))).otherwise(
        F.pmod(F.xxhash64("id"), F.greatest("qb", F.lit(1)))
    )
    dealt = dealt.withColumn("i", i)

    def upto(count):
        return F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).otherwise(
            F.array().cast("array<long>")
        )

    def tile(kind, p, q, side, within):
        return F.struct(
            F.xxhash64(*group, F.lit(kind), p, q).alias("tile"), side.cast("int").alias("side"), F.lit(within).alias("within")
        )

    at = F.col("i")
    inside = F.transform(upto("nb"), lambda j: tile("in", F.least(at, j), F.greatest(at, j), (at > j), True))
    asked = F.transform(upto("qb"), lambda j: tile("out", at, j, F.lit(0), False))
    asking = F.transform(upto("nb"), lambda j: tile("out", j, at, F.lit(1), False))
    dealt = dealt.withColumn("t", F.explode(F.when(F.col("stored"), F.concat(inside, asked)).otherwise(asking)))
    dealt = dealt.select("t.*", "dim", "list", "id", "n", "vector", "codes", "err")
    found = scratch.put(dealt.groupBy("tile").applyInArrow(_compare(shared, min_cosine, reach), _FOUND), "found")

    links = found.where("kind = 0").groupBy(F.col("a").alias("c1")).agg(F.sum("b").alias("links"))
    node = classes.select("c1", "id")
    roots = components(found.where("kind = 1").select("a", "b"), scratch, "links")
    roots = scratch.put(roots, "roots")
    smallest = roots.join(node.withColumnRenamed("c1", "node"), "node").groupBy("root").agg(F.min("id").alias("first"))
    belongs = roots.join(smallest, "root").select(F.col("node").alias("c1"), "first")
    answer = classes.join(links, "c1", "left").join(belongs, "c1", "left").select(
        "c1", "c2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", "id").alias("first")
    )
    out = rows.select("id", "c1", "c2").join(answer, ["c1", "c2"], "left")
    component = F.coalesce("first", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
