"""Reports over a findings table: ids, file headers, counts, JSON / Markdown / console.

A report is ordered by (file, line, column).  Ids are consecutive positions in that
order; they are computed without a single-partition window: the sorted findings are
written once (a lineage cut in the shared checkpoint folder), the rows per partition
are counted (one small row per partition), and each row adds its partition's offset
to its position inside the partition.

Text sinks write one block per finding, in order, with ``write.text``; the part
files, concatenated in order, form the whole report.  Only the block separators that
depend on a neighbour (first block, first finding of a file) need extra columns, and
those are computed with an aggregate + join, never with a global window.
"""

from __future__ import annotations

import json
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.model import FINDING_COLUMNS
from trawl.operators.cache import with_partition_offsets
from trawl.session import checkpoint_dir

ORDER = ["file_path", "line_number", "char_start_in_line"]

# Report texts of the original tool.
NO_MATCHES = "No matches found."
MD_TITLE = "# Code Search Results"


# ------------------------------------------------------------------------- ids and order


def with_positions(rows: DataFrame, order: list[str], name: str, checkpoint: bool = True) -> DataFrame:
    """``rows`` in the order of ``order``, with their 0-based position as column ``name`` in front.

    The rows are written once before sorting: a range sort samples its input in a
    separate job, which would otherwise compute them a second time."""
    if checkpoint:
        checkpoint_dir(rows.sparkSession)
        rows = rows.checkpoint(eager=True)
    ordered = rows.orderBy(*order)
    if checkpoint:
        ordered = ordered.checkpoint(eager=True)
    tagged = ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").count().orderBy("_pid").collect()  # one row per partition
    pos_in_part = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    tagged = with_partition_offsets(tagged.withColumn("_pos", pos_in_part), [(r["_pid"], r["count"]) for r in counts])
    return tagged.select((F.col("_off") + F.col("_pos")).cast("long").alias(name), *[c for c in rows.columns])


def with_finding_ids(findings: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Add ``finding_id`` (0-based, consecutive, in report order)."""
    return with_positions(findings, ORDER, "finding_id", checkpoint)


def lookup(findings_with_ids: DataFrame, finding_id) -> DataFrame:
    """A5: one finding by id.  Raises ``ValueError`` with the original messages."""
    try:
        n = int(finding_id)
    except (TypeError, ValueError):
        raise ValueError(f"Error: Finding ID '{finding_id}' must be an integer index.") from None
    row = findings_with_ids.where(F.col("finding_id") == n)
    if n < 0 or row.isEmpty():
        total = findings_with_ids.count()
        raise ValueError(f"Error: Finding ID {n} is out of range for the report (0 to {total - 1}).")
    return row


def match_count(findings: DataFrame) -> DataFrame:
    """A1."""
    return findings.agg(F.count("*").alias("total_matches"))


def file_firsts(findings: DataFrame) -> DataFrame:
    """The first finding of each file (partial aggregation: a hot file costs one row
    per partition before the shuffle)."""
    first = F.min(F.struct("line_number", "char_start_in_line")).alias("first")
    return findings.groupBy("file_path").agg(first).select(
        "file_path", F.col("first.line_number").alias("line_number"), F.col("first.char_start_in_line").alias("char_start_in_line")
    )


def with_file_headers(findings: DataFrame) -> DataFrame:
    """A2: ``new_file`` is true on the first finding of each file in report order.

    Joined on (file, line, column), which is unique per finding, so a file with many
    findings does not make a skewed join key.  ``findings`` is read twice: pass a
    materialized report (e.g. from :func:`with_finding_ids`), not a fresh search."""
    if "finding_id" in findings.columns:
        # the row before, by its id: a path that occurs twice has one header
        before = findings.select((F.col("finding_id") + 1).alias("finding_id"), F.col("file_path").alias("_before"))
        joined = findings.join(before, "finding_id", "left")
        return joined.withColumn("new_file", ~F.col("file_path").eqNullSafe(F.col("_before"))).drop("_before")
    firsts = file_firsts(findings).withColumn("new_file", F.lit(True))
    return findings.join(firsts, on=ORDER, how="left").withColumn("new_file", F.coalesce("new_file", F.lit(False)))


def files_per_root(listing: DataFrame) -> DataFrame:
    """A6."""
    return listing.groupBy("root").agg(F.count("*").alias("files"))


# ------------------------------------------------------------------------- text blocks

_JSON_FIELDS = ["file_path", "line_number", "match_text", "char_start_in_line", "char_end_in_line", "snippet"]


@F.pandas_udf(T.StringType())
def json_string(s: pd.Series) -> pd.Series:
    """``json.dumps`` of each string (ASCII-escaped, as the original JSON reports)."""
    return s.map(lambda v: None if v is None else json.dumps(v))


def json_element(cols: list[str], indent: int = 4) -> Column:
    """One finding as an element of ``json.dumps(list, indent=indent)``."""
    pad, inner = " " * indent, " " * (2 * indent)
    parts = []
    for i, c in enumerate(cols):
        value = json_string(F.col(c)) if c in ("file_path", "match_text", "snippet", "elaboration") else F.col(c).cast("string")
        sep = "," if i < len(cols) - 1 else ""
        parts += [F.lit(f'{inner}"{c}": '), value, F.lit(sep + "\n")]
    return F.concat(F.lit(pad + "{\n"), *parts, F.lit(pad + "}"))


def json_blocks(with_ids: DataFrame, total: int, indent: int = 4) -> DataFrame:
    """K1: ``(finding_id, value)``; the values, in id order, joined by ``\\n``, are
    the exact ``json.dumps(findings, indent=indent)`` text."""
    cols = [c for c in _JSON_FIELDS if c in with_ids.columns]
    if "elaboration" in with_ids.columns:
        cols.append("elaboration")
    fid = F.col("finding_id")
    head = F.when(fid == 0, F.lit("[\n")).otherwise(F.lit(""))
    tail = F.when(fid == total - 1, F.lit("\n]")).otherwise(F.lit(","))
    return with_ids.select("finding_id", F.concat(head, json_element(cols, indent), tail).alias("value"))


def _elaboration_md(el: Column) -> Column:
    return F.when(
        el.isNotNull() & (el != ""),
        F.concat(F.lit("\n\n**Elaboration:**\n> "), F.replace(el, F.lit("\n"), F.lit("\n> "))),
    ).otherwise(F.lit(""))


def markdown_blocks(with_ids: DataFrame, total: int) -> DataFrame:
    """K2: ``(finding_id, value)``; values in id order joined by ``\\n`` are the report."""
    fid = F.col("finding_id")
    title = F.when(fid == 0, F.lit(f"{MD_TITLE}\n\nFound {total} match(es) in total.\n")).otherwise(F.lit(""))
    rule = F.when(fid > 0, F.lit("\n---\n")).otherwise(F.lit(""))
    header = F.when(F.col("new_file"), F.concat(rule, F.lit("\n## File: `"), F.col("file_path"), F.lit("`\n"))).otherwise(F.lit(""))
    el = F.col("elaboration") if "elaboration" in with_ids.columns else F.lit(None).cast("string")
    body = F.concat(
        F.lit("\n### Match at Line "), F.col("line_number").cast("string"), F.lit("\n```text\n"),
        F.col("snippet"), F.lit("\n```"), _elaboration_md(el),
    )
    return with_file_headers(with_ids).select("finding_id", F.concat(title, header, body).alias("value"))


def _elaboration_console(el: Column) -> Column:
    lines = F.transform(F.split(el, "\n", -1), lambda x: F.concat(F.lit("    \U0001F4A1 "), x))
    return F.when(
        el.isNotNull() & (el != ""),
        F.concat(F.lit("\n\n    ✨ Elaborating...\n\n"), F.array_join(lines, "\n"), F.lit("\n    --------------------")),
    ).otherwise(F.lit(""))


def console_blocks(with_ids: DataFrame, total: int) -> DataFrame:
    """K3: ``(finding_id, value)``; joined by ``\\n`` in id order they are the console text."""
    el = F.col("elaboration") if "elaboration" in with_ids.columns else F.lit(None).cast("string")
    fid = F.col("finding_id")
    footer = F.when(fid == total - 1, F.lit(f"\n\nFound {total} match(es) in total.")).otherwise(F.lit(""))
    body = F.concat(
        F.lit("\nMatch in: "), F.col("file_path"), F.lit("\nLine "), F.col("line_number").cast("string"),
        F.lit(":\n"), F.col("snippet"), _elaboration_console(el), footer,
    )
    return with_ids.select("finding_id", body.alias("value"))


FORMATS = {"json": "json", "jsonl": "jsonl", "md": "md", "markdown": "md", "console": "console"}


def report_blocks(findings: DataFrame, fmt: str = "console", indent: int = 4) -> DataFrame:
    """K4: blocks of a report in the requested format (unknown format -> console);
    ``indent`` is that of the JSON form."""
    return _numbered_blocks(findings, fmt, indent)[0]


def _numbered_blocks(findings: DataFrame, fmt: str, indent: int) -> tuple[DataFrame, int]:
    kind = FORMATS.get(fmt.lower())
    if kind is None:
        warnings.warn(f"Unknown output format '{fmt}'. Defaulting to console.")
        kind = "console"
    with_ids = with_finding_ids(findings)
    total = with_ids.count()
    spark = findings.sparkSession
    if total == 0:
        empty = "[]" if kind == "json" else "" if kind == "jsonl" else NO_MATCHES
        return spark.range(1).select(F.lit(0).cast("long").alias("finding_id"), F.lit(empty).alias("value")), 0
    if kind == "json":
        return json_blocks(with_ids, total, indent), total
    if kind == "jsonl":
        return json_lines(with_ids), total
    if kind == "md":
        return markdown_blocks(with_ids, total), total
    return console_blocks(with_ids, total), total


def json_lines(with_ids: DataFrame) -> DataFrame:
    """One JSON object per finding, with its ``finding_id``: the form that is read back from
    many parts (:func:`trawl.sources.report.read_report_lines`)."""
    cols = ["finding_id", *[c for c in _JSON_FIELDS if c in with_ids.columns]]
    cols += ["elaboration"] if "elaboration" in with_ids.columns else []
    return with_ids.select("finding_id", F.to_json(F.struct(*cols)).alias("value"))


def write_report(findings: DataFrame, path: str, fmt: str = "console", indent: int = 4) -> int:
    """K6: write the report as ordered text part files under ``path``; returns the
    number of findings.  The part files, concatenated in order, are the report.
    Errors propagate to the caller."""
    blocks, total = _numbered_blocks(findings, fmt, indent)
    blocks.orderBy("finding_id").select("value").write.mode("overwrite").text(path)
    return total


def elaboration_json(elaborated: DataFrame) -> DataFrame:
    """K5: ``json.dumps({"elaboration": text}, indent=4)`` per row."""
    return elaborated.select(
        *[c for c in elaborated.columns if c != "elaboration"],
        F.concat(F.lit('{\n    "elaboration": '), json_string(F.col("elaboration")), F.lit("\n}")).alias("elaboration_json"),
    )


__all__ = [
    "FINDING_COLUMNS",
    "with_finding_ids",
    "lookup",
    "match_count",
    "with_file_headers",
    "files_per_root",
    "json_blocks",
    "markdown_blocks",
    "console_blocks",
    "report_blocks",
    "write_report",
    "elaboration_json",
]
