"""N-gram Jaccard self-join: documents whose sets of 5-word shingles have Jaccard
similarity of 3/4 or more, by size-banded tiles with hashed bitmap signatures.

1. Every text becomes a sorted array of shingle hashes; documents with equal sets form a
   class, represented by the smallest id.  Copies, however many, are one class from here.
2. Tiles.  Two sets that reach the threshold share an element among the first
   ``size // 4 + 1`` of each in any common order of elements.  The order used here: first
   the elements whose hash lies below ``LOW`` by document frequency (counted over all
   documents by one shuffle of these hashes), then the other elements by hash, last the
   commonest shingles (a broadcast table of at most ``COMMON_SHINGLES`` entries; which
   ones it holds changes only the cost).  A class with enough elements that nobody shares
   needs no look at the rest, so boilerplate does not chain documents.  Per element the
   classes are chained by size: neighbours whose sizes differ by more than the threshold
   allows break the chain.  The chains connect classes into coarse groups; a class without
   a neighbour has no partner at all.  Elements without a counted frequency are chained
   on the map side first, so a hot one is one row per task and chain.
3. Small groups share a tile; a large one is cut into bands by size (ratio 4/3) and blocks of
   bounded size, and every pair of blocks of the same or neighbouring bands is a tile.
4. In a tile each set gets a parity bitmap of its hashes: the bits in which two bitmaps
   differ cannot outnumber the elements in which the sets differ, which bounds the overlap
   from above.  Pairs that pass are verified by exact sorted-array intersection, unless
   the tile already knows them connected.  A tile returns a spanning forest of its links,
   never all pairs.
5. Connected components of the forests give the classes of linked documents.

The result is exact up to equality of 64-bit hashes.  Defined cases: null or blank texts have
an empty set, size 0, and are linked with nothing; rows with a null id take part in no
link and get a null component; rows repeating an id are one document, also if their texts differ:
what any of them is linked with is in their component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm import shingles
from trawl.llm.components import UnionFind, components, star_edges
from trawl.llm.scratch import Scratch, fits_broadcast

#: Entries of the broadcast table of common shingles (12 bytes each), and how often a slice of
#: ``SLICE_SHINGLES`` must hold a shingle to report it for the table.
COMMON_SHINGLES = 500_000
COMMON_IN_SLICE = 4
#: Share of the hash range whose elements are counted.
LOW = np.uint64(3 * 2**61)  # 3/8
#: Bounds of one block of a tile.
BLOCK_SETS = 2048
BLOCK_SHINGLES = 1 << 19
#: Shingles held at once by a slice of texts.
SLICE_SHINGLES = 1 << 19

#: Bytes of an id and text hash that is broadcast.
JUDGED_BYTES = 24

_FLAT = "kind int, id long, size int, d1 long, d2 long, th long"


def _batched_sets(batch: pa.RecordBatch):
    """(ids, sets) of the rows of (id, text) in slices of bounded size."""
    ids, sets, held = [], [], 0
    for doc, found in zip(batch.column(0).to_pylist(), shingles.text_sets(batch.column(1))):
        ids.append(doc)
        sets.append(found)
        held += len(found)
        if held >= SLICE_SHINGLES:
            yield ids, sets
            ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _table(schema: str, columns: list) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[part.split()[1]] for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _describe(batches):
    """Kind 0: a document with the size and fingerprints of its set and the hash of its text.
    Kind 1: a shingle (``id``) that this slice holds ``size`` times."""
    for batch in batches:
        done = 0
        for ids, sets in _batched_sets(batch):
            d1, d2 = shingles.digests(sets)
            n = len(ids)
            th = batch.column(2).slice(done, n).to_numpy()
            done += n
            yield _table(_FLAT, [np.zeros(n, np.int32), ids, np.array([len(s) for s in sets], np.int32), d1, d2, th])
            firsts = np.unique(d1, return_index=True)[1]
            flat = np.sort(np.concatenate([sets[i] for i in firsts.tolist()]))
            if len(flat):
                heads = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                counts = np.diff(np.append(heads, len(flat)))
                many = counts >= COMMON_IN_SLICE
                keys = flat[heads[many]].view(np.int64)
                zero = np.zeros(len(keys), np.int64)
                yield _table(_FLAT, [np.ones(len(keys), np.int32), keys, counts[many].astype(np.int32), zero, zero, zero])


def _common_rank(found: np.ndarray, common) -> np.ndarray:
    """How common each element is: 0 outside the table."""
    keys, counts = common
    if not len(keys):
        return np.zeros(len(found), np.int32)
    at = np.searchsorted(keys, found)
    at[at == len(keys)] = 0
    return np.where(keys[at] == found, counts[at], 0)


def _distinct_sets(batch: pa.RecordBatch, seen: set):
    """(node, set) of the classes of a batch that ``seen`` does not hold yet; a batch at a
    time, so copies in other batches come again."""
    for _, sets in _batched_sets(batch):
        d1, _ = shingles.digests(sets)
        for found, node in zip(sets, d1.tolist()):
            if len(found) and node not in seen:
                seen.add(node)
                yield node, found


def _low_elements(common):
    """(key, node) of the elements below ``LOW`` that are not common."""

    def run(batches):
        for batch in batches:
            keys, nodes, held = [], [], 0
            seen: set = set()
            for node, found in _distinct_sets(batch, seen):
                low = found[: np.searchsorted(found, LOW)]
                low = low[_common_rank(low, common.value) == 0]
                keys.append(low)
                nodes.append(np.full(len(low), node, np.int64))
                held += len(low)
                if held >= SLICE_SHINGLES:
                    yield _table("key long, node long", [np.concatenate(keys).view(np.int64), np.concatenate(nodes)])
                    keys, nodes, held = [], [], 0
            if held:
                yield _table("key long, node long", [np.concatenate(keys).view(np.int64), np.concatenate(nodes)])

    return run


_CHAINS = "kind int, a long, b long, lo int, hi int"


def _chain(key: np.ndarray, size: np.ndarray, node: np.ndarray):
    """Rows of (key, size, node) to chains (key, node, lo, hi) and edges (node, node)."""
    order = np.lexsort((size, key))
    key, size, node = key[order], size[order].astype(np.int64), node[order]
    joined = (key[1:] == key[:-1]) & (4 * size[:-1] >= 3 * size[1:])
    a, b = node[:-1][joined], node[1:][joined]
    heads = np.flatnonzero(np.concatenate([[True], ~joined]))
    tails = np.append(heads[1:], len(key)) - 1
    return (key[heads], node[heads], size[heads], size[tails]), (a, b)


def _rest_elements(common):
    """What the counted elements leave open.  Kind 0: a chain over an element without a
    counted frequency (a = element, b = a class in it, sizes lo to hi).  Kind 1: an edge
    between two classes of a chain.  Kind 2: a class (a), its size (lo) and its number of
    counted elements (hi)."""

    def run(batches):
        for batch in batches:
            nodes, sizes, lows, held = [], [], [], []
            seen: set = set()
            for node, found in _distinct_sets(batch, seen):
                rank = _common_rank(found, common.value)
                cut = int(np.searchsorted(found, LOW))
                n_low = int((rank[:cut] == 0).sum())
                nodes.append(node)
                sizes.append(len(found))
                lows.append(n_low)
                open_ = len(found) // 4 + 1 - n_low
                if open_ > 0:
                    rest = np.concatenate([found[:cut][rank[:cut] > 0], found[cut:]])
                    rank = np.concatenate([rank[:cut][rank[:cut] > 0], rank[cut:]])
                    head = rest[np.argsort(rank, kind="stable")[:open_]]
                    held.append((head, np.full(len(head), len(found), np.int32), np.full(len(head), node, np.int64)))
            zero = np.zeros(len(nodes), np.int64)
            yield _table(_CHAINS, [zero + 2, nodes, zero, sizes, lows])
            if held:
                key, size, node = (np.concatenate(part) for part in zip(*held))
                (k, n, lo, hi), (a, b) = _chain(key, size, node)
                yield _table(_CHAINS, [np.zeros(len(k), np.int32), k.view(np.int64), n, lo, hi])
                differ = a != b
                if differ.any():
                    a, b = star_edges(a[differ], b[differ])
                    zero = np.zeros(len(a), np.int32)
                    yield _table(_CHAINS, [zero + 1, a, b, zero, zero])

    return run


_SETS = "tile long, grp long, side int, node long, size int, hashes binary"


def _sets(batches):
    """(text, d1, node, grp, tiles) to one row per tile, with the set as bytes.  Rows whose text
    is not the one of the class (a repeated id) are left out."""
    for batch in batches:
        wanted = batch.column(1).to_numpy()
        start = 0
        held: list = []
        slim = pa.RecordBatch.from_arrays([batch.column(1), batch.column(0)], names=["id", "text"])
        for ids, sets in _batched_sets(slim):
            d1, _ = shingles.digests(sets)
            for k, found in enumerate(sets):
                row = start + k
                if d1[k] != wanted[row]:
                    continue
                node, grp = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                for tile in batch.column(4)[row].as_py():
                    held.append((tile["t"], grp, tile["s"], node, len(found), found.tobytes()))
            start += len(ids)
            if held:
                yield _table(_SETS, list(zip(*held)))
                held = []


def _signatures(sets: list, bits: int) -> np.ndarray:
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) & np.uint64(bits - 1)
    parity = np.bincount(owner * bits + flat.astype(np.int64), minlength=len(sets) * bits) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(sets), bits), axis=1).view(np.uint64)


def _links(sets: list, side: np.ndarray, num: int, den: int):
    """Spanning forest of the links among sets ordered by size (index pairs).  With two
    sides only pairs across them are compared."""
    size = np.array([len(s) for s in sets], np.int64)
    bits = 64
    while bits < 2 * size[-1] and bits < 8192:
        bits *= 2
    marks = np.concatenate([_signatures(sets[k : k + 64], bits) for k in range(0, len(sets), 64)])
    uf = UnionFind(len(sets))
    last = np.searchsorted(size, size * den // num, side="right")
    across = side.min() != side.max()
    for i in range(len(sets) - 1):
        j = slice(i + 1, last[i])
        if j.start >= j.stop:
            continue
        apart = np.bitwise_count(marks[i] ^ marks[j]).sum(axis=1, dtype=np.int64)
        both = size[i] + size[j]
        fits = (num + den) * ((both - apart) // 2) >= num * both  # the most they can share
        if across:
            fits &= side[j] != side[i]
        for k in (np.flatnonzero(fits) + i + 1).tolist():
            if uf.find(i) == uf.find(k):
                continue
            a, b = sets[i], sets[k]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int((b[at] == a).sum())
            if den * shared >= num * (len(a) + len(b) - shared):
                uf.union(i, k)
                yield i, k


def _tile(num: int, den: int):
    def run(key, table):
        got: list = []
        table = table.sort_by([("grp", "ascending"), ("size", "ascending"), ("node", "ascending")])
        grp = table.column("grp").to_numpy()
        node = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        hashes = table.column("hashes").combine_chunks()
        heads = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(grp)]):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(hashes[i].as_buffer(), np.uint64) for i in range(lo, hi)]
            for i, k in _links(sets, side[lo:hi], num, den):
                got.append((node[lo + i], node[lo + k]))
        a, b = zip(*got) if got else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _linked(docs: DataFrame, key: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(described, classes, links, several).  ``described(id, size, d1, d2, th)`` has a row per row; ``classes(size,
    d1, d2, node)`` the different sets with their smallest id; ``links(a, b)`` a spanning forest of the links
    between classes, told by ``d1``; ``several(id, set)`` the ids whose rows have different sets, with the largest."""
    num, den = 3, 4
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    hashed = slim.withColumn("th", _text_hash("text"))
    flat = scratch.put(hashed.mapInArrow(_describe, _FLAT), "sets")
    described = flat.where("kind = 0").drop("kind")
    whose = described.where("id is not null").groupBy("id")
    own = F.struct("size", "d1", "d2")
    ids = scratch.put(whose.agg(F.count(F.lit(1)).alias("n"), F.min(own).alias("least"), F.max(own).alias("set")).where("n > 1"), "ids")
    several = ids.where("least <> set").select("id", "set")
    top = (
        flat.where("kind = 1").groupBy("id").agg(F.sum("size").alias("n"))
        .orderBy(F.desc("n"), "id").limit(COMMON_SHINGLES).toArrow()
    )
    keys = top.column("id").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    counts = np.minimum(top.column("n").to_numpy(), 2**31 - 1).astype(np.int32)[order]
    common = spark.sparkContext.broadcast((keys[order], counts))
    known = slim.where("id is not null")

    # frequency of the counted elements; only those of more than one class go on
    whole = Window.partitionBy("key")
    shared = (
        known.mapInArrow(_low_elements(common), "key long, node long")
        .select(
            "key", "node", F.count(F.lit(1)).over(whole).alias("df"),
            F.min("node").over(whole).alias("least"), F.max("node").over(whole).alias("most"),
        )
        .where("least <> most")
    )
    shared = scratch.put(shared.groupBy("node", "key").agg(F.max("df").alias("df")), "shared")
    rest = scratch.put(known.mapInArrow(_rest_elements(common), _CHAINS), "rest")

    # the rarest shared elements that the unshared ones leave open, chained by size
    unshared = F.col("n_low") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "key"))
    counted = rest.where("kind = 2").groupBy(F.col("a").alias("node")).agg(F.max("lo").alias("size"), F.max("hi").alias("n_low"))
    firsts = (
        shared.join(counted, "node")
        .select("node", "key", "size", (F.floor(F.col("size") / 4) + 1 - unshared).alias("open"), rank.alias("rank"))
        .where("rank <= open")
    )
    chains = firsts.select(F.col("key").alias("a"), F.col("node").alias("b"), F.col("size").alias("lo"), F.col("size").alias("hi"))
    chains = chains.union(rest.where("kind = 0").select("a", "b", "lo", "hi"))
    along = Window.partitionBy("a").orderBy("lo", "b")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    met = (
        chains.select("a", "b", "lo", F.max("hi").over(before).alias("reach"), F.lag("b").over(along).alias("prev"))
        .where(f"prev is not null and {den} * reach >= {num} * lo and prev <> b")
        .select(F.col("prev").alias("a"), "b")
    )
    near = components(met.union(rest.where("kind = 1").select("a", "b")), scratch, "coarse")
    near = scratch.put(near, "near")
    for name in ("shared", "rest"):
        scratch.drop(name)

    # classes of equal sets, and those with a possible partner
    classes = described.where("size > 0 and id is not null").groupBy("size", "d1", "d2").agg(F.min("id").alias("node"))
    classes = scratch.put(classes, "classes")
    active = classes.join(near.select(F.col("node").alias("d1"), F.col("root").alias("grp")), "d1").select(
        "node", "d1", "size", "grp"
    )
    active = scratch.put(active, "active")
    n_active, all_shingles = active.agg(F.count("node"), F.sum("size")).first()
    tiles = _assign_tiles(active, n_active, all_shingles or 0)
    texts = slim.join(tiles.withColumnRenamed("node", "id"), "id")
    if not ids.isEmpty():  # of rows that repeat an id and a text one goes into the tiles
        texts = texts.withColumn("th", _text_hash("text")).dropDuplicates(["id", "d1", "th"])
    sets = texts.select("text", "d1", F.col("d1").alias("node"), "grp", "tiles").mapInArrow(_sets, _SETS)
    links = scratch.put(sets.groupBy("tile").applyInArrow(_tile(num, den), "a long, b long"), "links")
    return described, classes, links, several


def _grouped(classes: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``classes`` and ``root``, the same for classes that ``edges`` connect."""
    roots = scratch.put(components(edges, scratch, name), f"{name}-roots")
    grouped = classes.join(roots.withColumnRenamed("node", "d1"), "d1", "left")
    return grouped.withColumn("root", F.coalesce("root", "d1"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, ``n_shingles`` (long) and ``component_id``."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    described, classes, links, several = _linked(docs, key, text, scratch)
    repeated = not several.isEmpty()
    if repeated:  # the sets of one document belong together
        same = described.where("size > 0").join(several, "id").select(F.col("d1").alias("a"), F.col("set.d1").alias("b"))
        links = links.union(same)
    grouped = scratch.put(_grouped(classes, links, scratch, "fine"), "grouped")
    first = grouped.groupBy("root").agg(F.min("node").alias("component_id"))
    placed = grouped.join(first, "root").select("size", "d1", "d2", "component_id")
    if repeated:  # a row without words goes where the other rows of its id are
        described = described.join(several, "id", "left")
        at = {c: F.coalesce(F.col("set")[c], F.col(c)) for c in ("size", "d1", "d2")}
        described = described.select("id", F.col("size").alias("own"), *[c.alias(n) for n, c in at.items()])
    else:
        described = described.withColumn("own", F.col("size"))
    out = described.join(placed, ["size", "d1", "d2"], "left").withColumn("size", F.col("own"))
    return out.select(
        F.col("id").alias(key),
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of linked texts the one with the smallest id
    (ties: the smallest text hash) stays, once.  Here a text is a text, whatever other texts have its id: only
    rows whose text is linked to one that stays go.  Rows without words or id are linked with nothing and stay."""
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    described, classes, links, _ = _linked(docs, key, text, scratch)
    grouped = _grouped(classes, links, scratch, "keep").select("size", "d1", "d2", "root")
    rows = described.where("size > 0 and id is not null").groupBy("id", "th", "size", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    rows = scratch.put(rows.join(grouped, ["size", "d1", "d2"]).select("id", "th", "n", "root"), "rows")
    best = rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("best"))
    stays = F.struct("id", "th") == F.col("best")
    judged = rows.join(best, "root").select(F.col("id").alias("_nk_id"), F.col("th").alias("_nk_th"), "n", stays.alias("stays"))
    judged = scratch.put(judged.where("n > 1 or not stays"), "judged").drop("n")
    same = (F.col(key).cast("long") == F.col("_nk_id")) & (_text_hash(text) == F.col("_nk_th"))
    counts = judged.agg(F.count_if(~F.col("stays")), F.count_if("stays")).first()
    # texts stay where they are as long as the ids that meet them fit beside them
    gone, again = (
        F.broadcast(part) if fits_broadcast(n, JUDGED_BYTES) else part
        for part, n in zip((judged.where("not stays").drop("stays"), judged.where("stays").drop("stays")), counts)
    )
    left = docs.join(gone, same, "left_anti")
    if not counts[1]:
        return left
    once = left.join(again, same).dropDuplicates(["_nk_id", "_nk_th"]).drop("_nk_id", "_nk_th")
    return left.join(again, same, "left_anti").union(once)


def _assign_tiles(active: DataFrame, n: int, all_shingles: int) -> DataFrame:
    """(node, d1, grp, tiles): ``tiles`` lists (t, s), the tiles of a set and its side."""
    groups = active.groupBy("grp").agg(F.count("node").alias("g_n"), F.sum("size").alias("g_s"))
    small = (F.col("g_n") <= BLOCK_SETS) & (F.col("g_s") <= BLOCK_SHINGLES)
    packs = max(1, -(-n // BLOCK_SETS), -(-all_shingles // BLOCK_SHINGLES))
    here = active.join(groups, "grp").withColumn("small", small)
    one = here.where("small").select(
        "node", "d1", "grp",
        F.array(F.struct(F.pmod(F.xxhash64("grp"), F.lit(packs)).alias("t"), F.lit(0).alias("s"))).alias("tiles"),
    )
    band = F.floor(F.log("size") / F.log(F.lit(4.0 / 3.0)) + 1e-9).cast("int")
    banded = here.where("not small").withColumn("band", band)
    blocks = banded.groupBy("grp", "band").agg(
        F.greatest(F.ceil(F.count("node") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("nb")
    )
    up = blocks.select("grp", (F.col("band") - 1).alias("band"), F.col("nb").alias("nb_up"))
    down = blocks.select("grp", (F.col("band") + 1).alias("band"), F.col("nb").alias("nb_down"))
    blocks = blocks.join(up, ["grp", "band"], "left").join(down, ["grp", "band"], "left")
    banded = banded.join(blocks, ["grp", "band"]).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("nb")))

    def upto(count):
        return F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))

    def tile(b, kind, i, j, side):
        name = F.xxhash64("grp", b, F.lit(kind), i, j)
        return F.struct(name.alias("t"), side.cast("int").alias("s"))

    i, b = F.col("i"), F.col("band")
    same = F.transform(
        upto(F.col("nb")), lambda j: tile(b, "same", F.least(i, j), F.greatest(i, j), (j < i).cast("int"))
    )
    above = F.transform(upto(F.coalesce("nb_up", F.lit(0))), lambda j: tile(b, "next", i, j, F.lit(0)))
    below = F.transform(upto(F.coalesce("nb_down", F.lit(0))), lambda j: tile(b - 1, "next", j, i, F.lit(1)))
    cut = banded.select("node", "d1", "grp", F.concat(same, above, below).alias("tiles"))
    return one.select("node", "d1", "grp", F.col("tiles").cast("array<struct<t:long,s:int>>")).union(
        cut.select("node", "d1", "grp", F.col("tiles").cast("array<struct<t:long,s:int>>"))
    )
