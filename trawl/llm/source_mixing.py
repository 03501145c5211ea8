"""Mixing sources to target weights by systematic sampling.

Every source has a target in words (:func:`targets`).  Its documents are expected to appear
target / size times, at most twice.  In each source the documents stand by size, then by a
seeded digest of their id; the expected copies are summed up along that order and one random offset
of the source is added; a document is emitted once for every integer boundary that its stretch
of the sum crosses.  As neighbours are of like size, the words taken stay within about the largest
document of the target.

The sum is exact (integers in units of 1 / ``UNIT`` copies) and has two levels: ranges of the order
are dealt to tasks and counted, one prefix sum over the ranges of a source gives what lies before
each, and inside a range the sum follows from a row's index (:mod:`trawl.llm.ranks`).  No task
orders a whole source.

Defined cases: a null text has size 0; null is a source of its own, the last one; sources of
size 0 have target 0; documents of size 0 may be emitted, they add no words; equal rows are
sampled one by one; null ids are ordinary rows; the empty table gives no rows; other columns
are ignored unless carried.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.ranks import ranked, source_key
from trawl.llm.scratch import Scratch

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the corpus, as a fraction.
SHARE = (3, 2)
#: Copies of a source at most.
MOST = 2
UNIT = 10**12
SEED = "20240229"

BLANK = "\\x20\\x09-\\x0D"


def count_words(text: Column) -> Column:
    """Number of maximal runs without white space, without an array of them: every word and the
    white space after it become one character."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, f"[^{BLANK}]++[{BLANK}]*+", "x")).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *parts))


def targets(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources(src, words)`` to ``src, words, target, step``: the target in words, and the expected copies
    of a document in units of 1 / ``UNIT``.

    Sources in the order of ``src`` weigh ``WEIGHTS``, repeating, and share ``SHARE`` of all words; targets
    beyond ``MOST`` times their source stop there and the excess goes to the others by weight.  That is
    min(MOST * words, level * weight): the level is raised until no target is above, each time
    from two sums over the sources."""
    count, total = sources.agg(F.count(F.lit(1)), F.sum("words")).first()
    total = int(total or 0)
    named = ranked(sources.withColumn("all", F.lit("")), "all", ["src"], scratch, "sources", count)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    named = scratch.put(named.select("src", F.col("words").cast("long"), weight.cast("decimal(2,0)").alias("weight")), "weighed")

    def whole(value: int) -> Column:
        return F.lit(Decimal(value))

    up, down = SHARE
    level, full = (up * total, down * int(named.agg(F.sum("weight")).first()[0] or 1)), None
    while True:
        above = F.col("weight") * whole(level[0]) > F.col("words") * whole(MOST * level[1])
        held = named.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("words"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if held[0] == full:
            break
        full = held[0]
        level = (up * total - down * MOST * int(held[1] or 0), down * int(held[2] or 1))
    share = F.col("weight") * whole(level[0])
    target = F.when(above, (MOST * F.col("words")).cast("double")).otherwise(share.cast("double") / F.lit(float(level[1])))
    copies = F.expr(
        f"({UNIT}BD * weight * {level[0]}BD) div cast(greatest(words, 1) * cast({level[1]} as decimal(18,0)) as decimal(38,0))"
    )
    step = F.when(above, F.lit(MOST * UNIT)).otherwise(copies)
    return named.select("src", "words", target.alias("target"), step.cast("long").alias("step"))


def plan_mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", whole_rows: bool = False
) -> DataFrame:
    """One row per document: ``key``, ``size``, ``source_size``, ``target`` and ``copies``; with
    ``whole_rows`` also ``row``, a struct of all its columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.put(
        docs.select(
            source_key(source, null_first=False).alias("src"), F.col(key).alias("key"), count_words(F.col(text)).alias("n"),
            _digest(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("digest"),
            F.monotonically_increasing_id().alias("tie"),
            F.struct(*[F.col(c) for c in (docs.columns if whole_rows else [key])]).alias("row"),
        ),
        "sizes",
    )
    if not whole_rows:
        slim = slim.drop("row")
    aims = scratch.put(targets(slim.groupBy("src").agg(F.sum("n").alias("words")), scratch), "targets")
    placed = ranked(slim, "src", ["n", "digest", "key", "tie"], scratch, "documents", slim.count())
    offset = F.pmod(F.conv(F.substring(_digest(F.col("src")), 1, 15), 16, 10).cast("long"), F.lit(UNIT))

    def crossed(index: str) -> Column:
        return F.expr(f"(cast({index} as decimal(20,0)) * step + offset) div {UNIT}BD")

    return placed.join(aims.withColumn("offset", offset), "src").select(
        F.col("key").alias(key), F.col("n").alias("size"), F.col("words").alias("source_size"), "target",
        (crossed("rank + 1") - crossed("rank")).cast("int").alias("copies"), *(["row"] if whole_rows else []),
    )


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken."""
    plan = plan_mix(docs, key, text, source, whole_rows=True).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("time")
    return plan.select("row", times).select("row.*")
