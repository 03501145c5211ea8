"""Merkle manifest of a dataset: a hash tree per source, a tree over the sources, and for
every row the proof that ties it to the one root.

A row is a leaf: SHA-256 (lowercase hex) of its fields, each ``-`` if null, else its UTF-8
byte count, ``:`` and its value.  The leaves of a source ascend by id; every ``FAN``
consecutive nodes become the hash of their joined hashes until one is left, the subroot.
Subroots in the order of their sources (null first, then UTF-8 bytes) make the root alike.

Nested-struct rollup.  A leaf's rank in its source (:mod:`trawl.llm.ranks`) gives its
block, ``FAN ** LEVELS`` leaves, and one digit column per level.  One exchange brings a block
together; then the digit columns are grouped away one after the other, lowest first, each
step nesting up to ``FAN`` child structs (digit, hash, children) in their parent: no further
exchange, no group beyond ``FAN`` rows, and one row per block at the end.  The hashes of
the blocks are the leaves of the next round, ``log(rows) / log(FAN ** LEVELS)`` rounds in
all.  On the way down a block gets the path above it (a join of blocks, never of leaves),
and one nested transform and an explode give each leaf its siblings.

Defined cases: equal ids are ordered by leaf hash, wholly equal rows stand side by side;
null ids come first; null fields are ``-``, unlike empty ones; a source with one row is its own
subroot, with no sibling; the empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.ranks import ranked, source_key
from trawl.llm.scratch import Scratch

FAN = 3
LEVELS = 6
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NO_STEPS = "cast(array() as array<struct<l:string,r:string>>)"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def joined(nodes: Column) -> Column:
    """The hashes of an array of nodes, one after the other."""
    return F.array_join(F.transform(nodes, lambda c: c["hash"]), "")


def _has_parent(level: int) -> Column:
    """Whether the nodes below ``level`` are several in their group, so that they are hashed."""
    return F.col("size") > FAN ** (level - 1)


def _nested(nodes: DataFrame) -> DataFrame:
    """``nodes(grp, rank, size, hash, load)`` to one row per block: ``grp, block, size, hash`` of the
    block's top node and ``kids``, its nested children down to the nodes given."""
    digit = {k: F.expr(f"cast((rank div {FAN ** (k - 1)}) % {FAN} as int)").alias(f"d{k}") for k in range(1, LEVELS + 1)}
    rows = nodes.select(
        "grp", "size", F.expr(f"rank div {BLOCK}").alias("block"), *digit.values(), "hash", F.col("load").alias("kids")
    ).repartition("grp", "block")
    for level in range(1, LEVELS + 1):
        rest = [f"d{k}" for k in range(level + 1, LEVELS + 1)]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "hash", "kids")))
        top = F.when(_has_parent(level), F.sha2(joined(F.col("kids")), 256)).otherwise(F.col("kids")[0]["hash"])
        rows = (
            rows.groupBy("grp", "block", "size", *rest).agg(kids.alias("kids"))
            .select("grp", "block", "size", *rest, top.alias("hash"), "kids")
        )
    return rows


def _leaves(kids: Column, level: int, above: Column) -> Column:
    """The nodes at the bottom of ``kids`` as (load, hash, path); a path lists, from the node up,
    the joined hashes of the siblings to the left (l) and right (r)."""

    def one(child, i):
        step = F.struct(joined(F.slice(kids, 1, i)).alias("l"), joined(F.slice(kids, i + 2, FAN)).alias("r"))
        path = F.concat(F.when(_has_parent(level), F.array(step)).otherwise(F.expr(_NO_STEPS)), above)
        if level > 1:
            return _leaves(child["kids"], level - 1, path)
        return F.array(F.struct(child["kids"].alias("load"), child["hash"].alias("hash"), path.alias("path")))

    return F.flatten(F.transform(kids, one))


def prove(nodes: DataFrame, largest: int, top: Callable[[DataFrame], DataFrame], scratch: Scratch, name: str) -> DataFrame:
    """``nodes(grp, rank, size, hash, load)`` to ``grp, load, hash, path, subroot, root``, one row per node.
    ``largest`` is the size of the largest group; ``top`` maps (grp, hash) of the groups'
    top nodes to (grp, up, subroot, root), ``up`` being the path above them."""
    blocks = scratch.put(_nested(nodes), f"{name}-blocks")
    if largest <= BLOCK:
        above = top(blocks.select("grp", "hash")).withColumn("block", F.lit(0).cast("long"))
    else:
        higher = blocks.select(
            "grp", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), "hash",
            F.col("block").alias("load"),
        )
        above = prove(higher, -(-largest // BLOCK), top, scratch, f"{name}-up").select(
            "grp", F.col("load").alias("block"), F.col("path").alias("up"), "subroot", "root"
        )
    above = scratch.put(above, f"{name}-above")  # its measured size decides the kind of join
    leaf = F.explode(_leaves(F.col("kids"), LEVELS, F.col("up"))).alias("leaf")
    return (
        blocks.join(above, ["grp", "block"])
        .select("grp", leaf, "subroot", "root")
        .select("grp", "leaf.load", "leaf.hash", "leaf.path", "subroot", "root")
    )


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, suspect: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified`` per row of ``docs``.

    ``tampered`` maps field names to altered values and ``suspect`` says for which rows they hold:
    there ``folded_root`` folds the altered leaf with the original siblings, elsewhere the original
    leaf; ``verified`` says whether it is the root."""
    scratch = Scratch(docs.sparkSession, "merkle")
    given = [F.col(c) for c in FIELDS]
    altered = [(tampered or {}).get(c, F.col(c)) for c in FIELDS]
    other = F.when(suspect, leaf_hash(altered)) if suspect is not None else F.lit(None).cast("string")
    leaves = scratch.put(
        docs.select(
            source_key("source").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(given).alias("hash"),
            other.alias("altered"), F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    count = leaves.count()
    nodes = ranked(leaves, "grp", ["doc_id", "hash", "tie"], scratch, "leaves", count)
    nodes = nodes.select("grp", "rank", "size", "hash", F.struct("doc_id", "altered").alias("load"))
    largest = leaves.groupBy("grp").count().agg(F.max("count"), F.count("grp")).first()

    def over_sources(subroots: DataFrame) -> DataFrame:
        rows = ranked(subroots.withColumn("all", F.lit("")), "all", ["grp"], scratch, "sources", largest[1])
        rows = rows.select(F.col("all").alias("grp"), "rank", "size", "hash", F.col("grp").alias("load"))
        end = lambda tops: tops.select("grp", F.expr(_NO_STEPS).alias("up"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
        proofs = prove(rows, largest[1], end, scratch, "sources")
        return proofs.select(
            F.col("load").alias("grp"), F.col("path").alias("up"), F.col("hash").alias("subroot"), "root"
        )

    proofs = prove(nodes, largest[0] or 0, over_sources, scratch, "leaves")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    folded = F.aggregate(
        "path", F.coalesce(F.col("load.altered"), F.col("hash")), lambda acc, s: F.sha2(F.concat(s["l"], acc, s["r"]), 256)
    )
    return proofs.select(
        F.col("load.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "path",
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
