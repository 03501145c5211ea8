"""Table corpora: any table with an id and a text column becomes ``(path, text, mtime)``.

Only the columns a search needs are selected, so Parquet reads just those.  Every row gets a
path: a null part of it is written as ``_``, and a page without a url goes by its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


UNKNOWN = "_"


def part(column: str):
    """A part of a path, never null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def document_path(source="source", lang="lang", doc_id="doc_id", ext: str = "txt"):
    """Synthetic file path of a document: ``/corpus/<source>/<lang>/doc_<id>.<ext>``."""
    return F.concat(
        F.lit("/corpus/"), part(source), F.lit("/"), part(lang), F.lit("/doc_"), part(doc_id), F.lit("." + ext),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a corpus; ``doc_id`` seconds stand in for mtime."""
    d = table(spark, sf_dir, "documents")
    return d.select(document_path().alias("path"), "text", F.col("doc_id").cast("double").alias("mtime"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as a corpus: the URL is the path, the raw HTML the text."""
    p = table(spark, sf_dir, "pages")
    path = F.coalesce("url", F.concat(F.lit("/pages/"), part("page_id"), F.lit(".html")))
    return p.select(path.alias("path"), F.col("html").alias("text"), F.col("page_id").cast("double").alias("mtime"))


def conversation_path(conv_id="conv_id", turn="turn"):
    return F.concat(F.lit("/conversations/"), part(conv_id), F.lit("/"), part(turn), F.lit(".txt"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a corpus: ``/conversations/<conv_id>/<turn>.txt``."""
    c = table(spark, sf_dir, "conversations")
    return c.select(conversation_path().alias("path"), "text", F.col("conv_id").cast("double").alias("mtime"))


def document_tree_path():
    """A synthetic file tree over ``documents``, used to exercise the path rules.

    ``/corpus/<source>/<dir>/doc_<id>.<ext>``: German texts sit in a hidden ``.de``
    folder, Spanish ones in ``node_modules``; a few sources get their own extension.
    """
    lang, source = part("lang"), part("source")
    folder = F.when(lang == "de", ".de").when(lang == "es", "node_modules").otherwise(lang)
    ext = (
        F.when(source == "src0", "log")
        .when(source == "src1", "PDF")
        .when(source == "src2", "tmp")
        .when(source == "src3", "md")
        .otherwise("txt")
    )
    return F.concat(
        F.lit("/corpus/"), source, F.lit("/"), folder, F.lit("/doc_"), part("doc_id"), F.lit("."), ext
    )


def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a listing of files under the root ``/corpus``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        document_tree_path().alias("path"),
        F.lit("/corpus").alias("root"),
        "text",
        F.col("doc_id").cast("double").alias("mtime"),
    )
