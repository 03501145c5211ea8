"""Exact ranks inside groups, without ordering a whole group in one task.

Rows are dealt by ranges of (group, order columns) and sorted inside their range, so a row
knows its index there; the rows of each group in each range are counted, and one prefix sum
over the ranges of a group (one row per range) gives where its rows begin.  A group that
holds a third of all rows is simply many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.scratch import Scratch

ROWS_PER_RANGE = 200_000
#: ``monotonically_increasing_id`` keeps the partition above this bit, the index below it.
PART_BIT = 33


def source_key(column: str, null_first: bool = True):
    """A string key with the order of the column's UTF-8 bytes in which null has a place."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("" if null_first else ">"))


def ranked(rows: DataFrame, group: str, order: list[str], scratch: Scratch, name: str, n: int) -> DataFrame:
    """``rows`` and ``rank`` (from 0 inside its group) and ``size`` (rows of the group).
    ``n`` is the number of rows; ``group`` must not be null and ``order`` should end in a
    column that tells equal rows apart, or a hot run of equal rows is one range."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    by = [group, *order]
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = scratch.put(placed.withColumn("_rk_at", F.monotonically_increasing_id()), f"{name}-placed")
    part = F.shiftrightunsigned("_rk_at", PART_BIT)
    here = placed.groupBy(F.col(group).alias("_rk_group"), part.alias("_rk_part")).agg(
        F.count(F.lit(1)).alias("_rk_n"), F.min("_rk_at").alias("_rk_first")
    )
    whole = Window.partitionBy("_rk_group")
    before = whole.orderBy("_rk_part").rowsBetween(Window.unboundedPreceding, -1)
    here = scratch.put(
        here.select(
            "_rk_group", "_rk_part",
            (F.coalesce(F.sum("_rk_n").over(before), F.lit(0)) - F.col("_rk_first")).alias("_rk_shift"),
            F.sum("_rk_n").over(whole).alias("size"),
        ),
        f"{name}-ranges",
    )
    same = (F.col(group) == F.col("_rk_group")) & (part == F.col("_rk_part"))
    return placed.join(here, same).select(
        *rows.columns, (F.col("_rk_at") + F.col("_rk_shift")).alias("rank"), "size"
    )
