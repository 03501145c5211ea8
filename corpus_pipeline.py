"""Corpus pipeline over the ``documents`` table: STAGES, each one operator of trawl.llm.

1. language ID: documents without a letter, or whose confidence (that of their positions, so
   a text in several languages keeps its own) stays below the least one calibrated on the whole
   texts of all labelled rows, go; a null ``lang`` is filled with the prediction.
2. n-gram Jaccard join: of each group of linked texts the row with the smallest id stays, once; a
   text that is like no kept text never goes, whatever other rows have its id.
3. secret scans: every span is masked and ``n_chars`` follows; no document goes.
4. best-fit packing: the pieces of all documents with their place in a sequence.

Each stage takes ``(spark, docs, sf_dir)`` and works on the rows its predecessor kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import language_id, ngram_join, packing, secret_scan
from trawl.llm.queries import held_out, tokenizer_path
from trawl.llm.scratch import Scratch
from trawl.session import ship_package


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    net = language_id.fit(docs, ~held_out(), calibrate=True)
    taken = {c.lower() for c in docs.columns}
    into = tuple(next(c + "_" * n for n in range(1, len(taken) + 2) if c + "_" * n not in taken) for c in ("lang_pred", "score", "sure"))
    kept = language_id.predict(docs, net, keep=tuple(docs.columns), into=into)
    pred, _, sure = into
    kept = kept.where((F.col(pred) != language_id.UNKNOWN) & (F.col(sure) >= (net.least if net else 0.0)))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained network and tokenizer ids cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
