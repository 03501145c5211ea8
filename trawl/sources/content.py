"""Turning file bytes into text the way the original tool reads files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_text(content: Column, universal_newlines: bool = True) -> Column:
    """UTF-8 if the bytes are valid UTF-8, else ISO-8859-1 (which never fails).

    Files are read in text mode, so ``\\r\\n`` and a lone ``\\r`` become ``\\n`` before
    any matching.  Table corpora are not files and keep their text as is.
    """
    text = F.when(content.isNull(), F.lit(None).cast("string")).when(
        F.is_valid_utf8(content), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n") if universal_newlines else text


def decoded(files: DataFrame) -> DataFrame:
    """``(path, content, ...)`` -> ``(path, text, ...)``; unreadable rows drop out."""
    cols = [c for c in files.columns if c != "content"]
    return files.select(*cols, decode_text(F.col("content")).alias("text")).where(F.col("text").isNotNull())
