"""Continuous search: new corpus files are searched as they arrive.

The original tool re-searches only inputs that are new or changed (its result cache).
The streaming form of that idea: a Structured Streaming query over a folder of corpus
Parquet files (``path, text`` columns, or any table mapped to them), searching each
micro-batch with the same plan as a batch search and appending the findings to a
Parquet table.  The file source remembers which files were processed in its
checkpoint, so each file is searched exactly once, across restarts and lost
executors.  No state is kept per document: the search is a stateless map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trawl.model import FINDING_COLUMNS, Query
from trawl.plans.search import find


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Asked of the file system that the path belongs to."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(target).isDirectory()


def corpus_stream(
    spark: SparkSession,
    source: str,
    schema,
    to_corpus: Callable[[DataFrame], DataFrame] | None = None,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """A streaming corpus ``(path, text, ...)`` over ``source``: a folder of Parquet files, to which
    more may come, or one Parquet file."""
    reader = spark.readStream.schema(schema)
    if not _is_folder(spark, source):  # file streams watch folders: this one, for one name
        source, _, name = source.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(source)
    return to_corpus(raw) if to_corpus else raw


def start_search_stream(
    corpus: DataFrame,
    query: Query,
    sink_dir: str,
    checkpoint_location: str,
    available_now: bool = False,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Append the findings of ``query`` over a streaming corpus to ``sink_dir``."""
    findings = find(corpus, query).select(*FINDING_COLUMNS)
    writer = findings.writeStream.format("parquet").option("checkpointLocation", checkpoint_location).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(sink_dir)


def run_until_caught_up(corpus: DataFrame, query: Query, sink_dir: str, checkpoint_location: str) -> DataFrame:
    """Process every file present now (``availableNow``), then return the sink table."""
    q = start_search_stream(corpus, query, sink_dir, checkpoint_location, available_now=True)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return corpus.sparkSession.read.parquet(sink_dir)
