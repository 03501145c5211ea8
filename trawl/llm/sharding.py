"""Proportional stratified interleaving: rows into shards that all match the mixture.

Within each source the rows are shuffled by a seeded hash and ranked; the fractional rank
``(rank + jitter of the source) / rows of the source`` spreads every source evenly over
(0, 1).  All rows sorted by fractional rank form one sequence; cutting it into equal
stretches gives shards whose row counts differ by at most one and whose share of every
source matches the whole.

Ranks are found without ordering a whole source or the whole table in one task: rows are
bucketed by hash (or by fractional rank) into buckets of about ``rows_per_bucket`` rows,
bucket counts are summed up, and only the rows of a bucket are ordered in a window.  A
source that holds a third of all rows is many buckets.

Defined cases: null sources are a stratum of their own; null keys are ordinary rows; equal
rows get neighbouring but different slots; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch, fits_broadcast

SHARDS = 24
SEED = 20240229
ROWS_PER_BUCKET = 1000
#: Buckets summed up in one window group when offsets are computed.
BUCKETS_PER_CHUNK = 4096


def _offsets(counts: DataFrame, index: str, n: str, out: str) -> DataFrame:
    """``out`` = rows in all buckets before this one.  Two levels: within chunks of
    ``BUCKETS_PER_CHUNK`` buckets, then over the chunk totals."""
    chunk = F.floor(F.col(index) / BUCKETS_PER_CHUNK)
    chunked = counts.withColumn("_sh_chunk", chunk)
    totals = chunked.groupBy("_sh_chunk").agg(F.sum(n).alias("_sh_total"))
    before = Window.orderBy("_sh_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_sh_chunk", F.coalesce(F.sum("_sh_total").over(before), F.lit(0)).alias("_sh_base"))
    inner = Window.partitionBy("_sh_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.join(totals, "_sh_chunk")
        .select(index, (F.col("_sh_base") + F.coalesce(F.sum(n).over(inner), F.lit(0))).alias(out))
    )


def interleave(
    rows: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    carry: dict[str, Column] | None = None,
    shards: int = SHARDS,
    seed: int = SEED,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``key``, the ``carry`` columns, ``shard`` (0 to ``shards`` - 1) and ``slot``
    (gapless from 0 within a shard).  ``carry`` maps output names to expressions over the
    input; only these, the key and the source are shuffled, never other columns."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharding")
    carry = carry or {}
    slim = rows.select(
        F.col(key).alias("_sh_key"),
        F.struct(*[e.alias(n) for n, e in carry.items()], F.lit(0).alias("_sh_pad")).alias("_sh_carry"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_sh_src"),
    ).withColumn("_sh_hash", F.xxhash64(F.lit(seed), F.col("_sh_key"), F.col("_sh_carry")))
    slim = scratch.put(slim, "rows")

    strata = slim.groupBy("_sh_src").agg(F.count(F.lit(1)).alias("_sh_n"))
    strata = scratch.put(
        strata.withColumn(
            "_sh_jitter",
            (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_sh_src")), 12) + F.lit(0.5)) / F.lit(float(1 << 52)),
        ),
        "strata",
    )
    size = strata.agg(F.count(F.lit(1)), F.sum("_sh_n"), F.sum(F.length("_sh_src"))).first()
    total = size[1] or 0
    # sources are few as a rule and then broadcast; many sources go by a shuffle join
    small = F.broadcast(strata) if fits_broadcast(1, size[0] * 64 + (size[2] or 0) * 4) else strata

    # rank within the source
    bucketed = slim.join(small, "_sh_src").withColumn(
        "_sh_b", F.pmod(F.col("_sh_hash"), F.ceil(F.col("_sh_n") / rows_per_bucket))
    )
    per_bucket = bucketed.groupBy("_sh_src", "_sh_b").agg(F.count(F.lit(1)).alias("_sh_rows"))
    ahead = Window.partitionBy("_sh_src").orderBy("_sh_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(
        "_sh_src", "_sh_b", F.coalesce(F.sum("_sh_rows").over(ahead), F.lit(0)).alias("_sh_before")
    )
    in_bucket = Window.partitionBy("_sh_src", "_sh_b").orderBy("_sh_hash", "_sh_key")
    ranked = (
        bucketed.join(per_bucket, ["_sh_src", "_sh_b"])
        .withColumn("_sh_rank", F.col("_sh_before") + F.row_number().over(in_bucket) - 1)
        .withColumn("_sh_f", (F.col("_sh_rank") + F.col("_sh_jitter")) / F.col("_sh_n"))
        .select("_sh_key", "_sh_carry", "_sh_src", "_sh_hash", "_sh_f")
    )

    # place in the whole sequence
    buckets = max(1, -(-total // rows_per_bucket))
    ranked = scratch.put(
        ranked.withColumn("_sh_fb", F.least(F.floor(F.col("_sh_f") * buckets), F.lit(buckets - 1))), "ranked"
    )
    counts = ranked.groupBy("_sh_fb").agg(F.count(F.lit(1)).alias("_sh_rows"))
    starts = _offsets(counts, "_sh_fb", "_sh_rows", "_sh_start")
    in_order = Window.partitionBy("_sh_fb").orderBy("_sh_f", "_sh_src", "_sh_hash", "_sh_key")
    placed = ranked.join(starts, "_sh_fb").withColumn(
        "_sh_pos", F.col("_sh_start") + F.row_number().over(in_order) - 1
    )
    shard = F.expr(f"(_sh_pos * {shards}) div {max(total, 1)}")
    first = F.expr(f"(_sh_shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_sh_shard", shard)
        .select(
            F.col("_sh_key").alias(key),
            *[F.col("_sh_carry")[n].alias(n) for n in carry],
            F.col("_sh_shard").cast("int").alias("shard"),
            (F.col("_sh_pos") - first).cast("long").alias("slot"),
        )
    )
