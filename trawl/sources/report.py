"""Reading findings back from JSON reports (the original tool's report format)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("match_text", T.StringType()),
        T.StructField("char_start_in_line", T.LongType()),
        T.StructField("char_end_in_line", T.LongType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("elaboration", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def report_status(spark: SparkSession, path: str) -> DataFrame:
    """Per report file: is it a JSON array at all (``Error: ... not in the expected list
    format`` otherwise)?"""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(
        F.input_file_name().alias("report"),
        F.ltrim(F.col("value")).startswith("[").alias("is_list"),
    )


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the JSON array report(s) at ``path`` with ``finding_id`` = position
    in the array.  A report is one JSON document, so one file is read by one task;
    several reports are read in parallel.  Missing keys come back as nulls (see
    ``elaborate.validate``); unparsable text shows in ``_corrupt_record``."""
    df = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    df = df.withColumn("report", F.input_file_name()).withColumn("_mid", F.monotonically_increasing_id())
    w = Window.partitionBy("report").orderBy("_mid")
    return df.withColumn("finding_id", (F.row_number().over(w) - 1).cast("long")).drop("_mid")


def read_report_lines(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a JSON-lines report (``write_report(..., "jsonl")``): any number of parts, read
    in parallel, each finding with the id it was written with."""
    fields = ["finding_id bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in REPORT_SCHEMA if f.name != "_corrupt_record")]
    return spark.read.schema(", ".join(fields)).json(path)
