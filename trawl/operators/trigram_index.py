"""A corpus with an index of trigrams, for many searches over the same texts (M9).

:func:`build_index` writes two tables into a folder::

    texts/block=<b>/   place, path, text, mtime      the corpus, cut into blocks of documents
    postings/          trigram, block, n, deltas     the places of a block that hold a trigram

``deltas`` are the differences of ascending places, so Parquet stores them as small numbers; the postings of a file are
sorted by trigram, so that a reader of few trigrams skips most row groups.  Postings come from the written
blocks, one batch of rows at a time: nothing is grouped over the corpus, and only postings are shuffled.

A search turns its query into a Boolean expression over trigrams, reads the postings of those trigrams, meets them
block by block (a group holds at most trigrams x documents of a block numbers), and reads the texts of the
blocks with candidates only.  The candidates are searched as in any other search, so results are the same.
A query that asks for no trigram (short, or no literal in it) searches all texts.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import trigrams as TG
from trawl.model import Query
from trawl.plans.search import empty_findings, find

DOCS_PER_BLOCK = 10_000
#: Candidates (block and place) are broadcast up to this measured number, else they are shuffled.
BROADCAST_CANDIDATES = 2_000_000
#: Blocks are named to the reader up to this number; beyond it the join alone picks the texts.
NAMED_BLOCKS = 10_000
TEXTS = "place long, path string, text string, mtime double, block long"
POSTINGS = "trigram int, block long, n int, deltas array<int>"
#: Postings that a task collects before it emits them.
HELD_POSTINGS = 4_000_000


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("trigram", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("deltas", pa.list_(pa.int32()))])
    held: dict[int, list] = {}

    def emit(block: int, found: list) -> pa.RecordBatch:
        trigram = np.concatenate([codes for _, codes in found])
        place = np.concatenate([np.full(len(codes), at, dtype=np.int64) for at, codes in found])
        order = np.lexsort((place, trigram))
        trigram, place = trigram[order], place[order]
        first = np.flatnonzero(np.r_[True, trigram[1:] != trigram[:-1]])
        deltas = np.diff(place, prepend=0)
        deltas[first] = place[first]
        ends = np.r_[first, len(trigram)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(deltas, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(trigram[first], pa.int32()), pa.array(np.full(len(first), block), pa.int64()), pa.array(np.diff(ends), pa.int32()), lists],
            schema=schema,
        )

    size = 0
    for batch in batches:
        for block, place, data in zip(*(batch.column(i) for i in range(3))):
            codes = TG.codes(data.as_py())
            if len(codes):
                held.setdefault(block.as_py(), []).append((place.as_py(), codes))
                size += len(codes)
            if size >= HELD_POSTINGS:
                yield from (emit(b, found) for b, found in held.items())
                held, size = {}, 0
    yield from (emit(b, found) for b, found in held.items())


def build_index(corpus: DataFrame, folder: str, docs_per_block: int = DOCS_PER_BLOCK) -> None:
    """Writes ``corpus`` (``path, text`` and perhaps ``mtime``) and its trigram postings into ``folder``.

    Rows with a null or empty text are kept and are never candidates; a null path is the empty name; paths may repeat."""
    spark, folder = corpus.sparkSession, folder.rstrip("/")
    row = F.monotonically_increasing_id()  # split in the upper bits, row of the split in the lower 33
    per_split = (1 << 33) // docs_per_block + 1
    mtime = F.col("mtime").cast("double") if "mtime" in corpus.columns else F.lit(None).cast("double")
    numbered = corpus.select(F.coalesce("path", F.lit("")).alias("path"), "text", mtime.alias("mtime"), row.alias("_row"))
    low = F.col("_row").bitwiseAND((1 << 33) - 1)
    block = F.shiftright("_row", 33) * per_split + F.floor(low / docs_per_block)
    placed = numbered.select((low % docs_per_block).alias("place"), "path", "text", "mtime", block.cast("long").alias("block"))
    placed.write.partitionBy("block").parquet(f"{folder}/texts")
    texts = spark.read.schema(TEXTS).parquet(f"{folder}/texts").where(F.length("text") > 0)
    raw = texts.select("block", "place", F.encode(TG.folded(F.col("text")), "UTF-8").alias("data"))
    found = raw.mapInArrow(_postings, POSTINGS)
    # hashed, not by ranges: their sampling would make all postings twice; groups of blocks split a common trigram
    spread = found.repartition("trigram", F.shiftright("block", 10))
    spread.sortWithinPartitions("trigram", "block").write.parquet(f"{folder}/postings")


def candidates(spark: SparkSession, folder: str, query: Query) -> DataFrame | None:
    """``(block, place)`` of the documents that hold what the query asks for; ``None`` if it asks for nothing."""
    expression = TG.trigram_query(query)
    if expression is None:
        return None
    postings = spark.read.schema(POSTINGS).parquet(f"{folder.rstrip('/')}/postings")
    asked = postings.where(F.col("trigram").isin(sorted(TG.asked_codes(expression)))).select("block", "trigram", "deltas")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        lists: dict[int, list] = {}
        for code, deltas in zip(pdf["trigram"], pdf["deltas"]):
            lists.setdefault(int(code), []).append(np.cumsum(np.asarray(deltas, dtype=np.int64)))
        places = TG.evaluate(expression, {code: np.unique(np.concatenate(found)) for code, found in lists.items()})
        return pd.DataFrame({"block": np.full(len(places), pdf["block"].iloc[0], dtype=np.int64), "place": places.astype(np.int64)})

    return asked.groupBy("block").applyInPandas(meet, "block long, place long")


def candidate_texts(spark: SparkSession, folder: str, query: Query) -> DataFrame:
    """The texts that may match; only files of blocks with a candidate are read."""
    texts = spark.read.schema(TEXTS).parquet(f"{folder.rstrip('/')}/texts")
    hits = candidates(spark, folder, query)
    if hits is None:
        return texts.select("path", "text", "mtime")
    hits = hits.checkpoint(eager=True)
    blocks = [r.block for r in hits.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    if len(blocks) <= NAMED_BLOCKS:
        texts = texts.where(F.col("block").isin(blocks) if blocks else F.lit(False))
    small = hits.count() <= BROADCAST_CANDIDATES
    return texts.join(F.broadcast(hits) if small else hits, ["block", "place"], "left_semi").select("path", "text", "mtime")


def find_indexed(spark: SparkSession, folder: str, query: Query) -> DataFrame:
    """Unordered findings of ``query`` over the indexed corpus: those of :func:`trawl.plans.search.find`."""
    from trawl.session import checkpoint_dir

    checkpoint_dir(spark)
    if query.is_empty:
        return empty_findings(spark.read.schema(TEXTS).parquet(f"{folder.rstrip('/')}/texts"))
    return find(candidate_texts(spark, folder, query), query)
