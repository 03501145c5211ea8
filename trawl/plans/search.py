"""End-to-end search: corpus DataFrame + Query -> findings DataFrame.

Routing is decided on the driver from the query alone; data never passes through
the driver.  Plan shape for the common case (literal, or a line-safe regex)::

    Scan(path, text) -> Filter(document test) [-> Exchange, small inputs only]
      [-> ArrowEvalPython, NULL for all but the rare documents needing Python]
      -> Project(line arrays) -> Generate(hit lines) -> Project(context)
      -> Generate(occurrences) -> Project(findings)
      [-> checkpoint -> Sort, for report order]

The document test (``contains`` on the text or on a literal every match must hold,
else ``rlike``) runs first, so the line split only happens for documents that can
match at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.functions.regex_dialect import (
    java_line_pattern,
    jvm_may_differ,
    literal_test,
    required_literal,
)
from trawl.model import FINDING_COLUMNS, Query
from trawl.session import checkpoint_dir
from trawl.operators.match import (
    JVM_ONLY_LOWER,
    JVM_ONLY_LOWERED,
    LENGTH_CHANGING_LOWER,
    native_literal,
    native_regex,
    python_route,
)

ORDER = ["file_path", "line_number", "char_start_in_line"]


def searchable(corpus: DataFrame) -> DataFrame:
    """Only ``path`` and ``text`` go on; empty and unreadable texts have no matches.  A row
    without a path is searched under the empty name."""
    text = F.col("text")
    named = F.coalesce(F.col("path"), F.lit("")).alias("path")
    return corpus.select(named, "text").where(text.isNotNull() & (F.length(text) > 0))


def empty_findings(corpus: DataFrame) -> DataFrame:
    """No matches (empty query): keeps the lineage and the schema, reads nothing."""
    return corpus.select(
        F.coalesce(F.col("path"), F.lit("")).alias("file_path"),
        F.lit(0).cast("long").alias("line_number"),
        F.lit("").alias("match_text"),
        F.lit(0).cast("long").alias("char_start_in_line"),
        F.lit(0).cast("long").alias("char_end_in_line"),
        F.lit("").alias("snippet"),
    ).where(F.lit(False))


def spread(df: DataFrame, per_core: int = 4, max_factor: int = 64) -> DataFrame:
    """Give a CPU-heavy stage enough tasks.

    A large corpus is read in many splits already and is left alone (no shuffle).
    Only when the scan yields fewer partitions than the cluster has cores (small
    tables stored as one row group) are the surviving rows spread round-robin, to
    ``per_core`` tasks per core but at most ``max_factor`` times the input's
    partitions (a small input on a large cluster does not become thousands of tasks).
    """
    if df.isStreaming:
        return df  # micro-batches are sized by the source
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    if n >= cores:
        return df
    return df.repartition(max(1, min(cores * per_core, n * max_factor)))


def route(query: Query) -> str:
    """Which physical route a query takes: ``native`` or ``python``."""
    if query.regex:
        return "native" if java_line_pattern(query) else "python"
    if "\n" in query.text or "\r" in query.text:
        return "python"
    if not query.case_sensitive:
        if len(query.text.lower()) != len(query.text):
            return "python"
        if any(ch in JVM_ONLY_LOWER or ch in JVM_ONLY_LOWERED for ch in query.text):
            return "python"
    return "native"


def find(corpus: DataFrame, query: Query) -> DataFrame:
    """Unordered findings of ``query`` over ``corpus`` (columns ``FINDING_COLUMNS``)."""
    if query.is_empty:
        return empty_findings(corpus)
    docs = searchable(corpus)
    text = F.col("text")
    if not query.regex:
        needle = query.text if query.case_sensitive else query.text.lower()
        hay = text if query.case_sensitive else F.lower(text)
        matching = docs.where(hay.contains(needle))
        if route(query) == "python":
            if not query.case_sensitive and any(ch in JVM_ONLY_LOWER or ch in JVM_ONLY_LOWERED for ch in query.text):
                matching = docs  # Spark's lower() would fold these letters unlike Python
            return python_route(spread(matching), query)
        if query.case_sensitive:
            return native_literal(spread(matching), query)
        # documents whose lower-casing shifts offsets (rare) are answered by the
        # Python model inside the same pass
        return native_literal(spread(matching), query, odd=text.contains(LENGTH_CHANGING_LOWER))
    java = java_line_pattern(query)
    must = required_literal(query)
    # a literal every match contains is a cheap document test (compiled `contains`);
    # the regex itself then only runs on candidate documents, after spreading
    odd = jvm_may_differ(query, text) if java is not None else None
    if must:
        cand = docs.where(literal_test(text, query, must))
    elif java is not None:
        cand = docs.where(text.rlike(java) if odd is None else text.rlike(java) | odd)
    else:
        cand = docs
    if java is None:
        return python_route(spread(cand), query)
    # the few documents on which the engines' character tables differ are answered by Python
    return native_regex(spread(cand), query, java, odd=odd, must=must)


def search(corpus: DataFrame, query: Query, ordered: bool = True) -> DataFrame:
    """Findings in report order (path, line, column) unless ``ordered=False``.

    Ordering writes the findings once to the shared checkpoint folder and sorts that
    copy: a range sort samples its input in a separate job, which would otherwise run
    the whole search twice.  (So ``ordered=True`` starts a job right away.)"""
    found = find(corpus, query).select(*FINDING_COLUMNS)
    if not ordered or found.isStreaming:
        return found
    checkpoint_dir(found.sparkSession)
    return found.checkpoint(eager=True).orderBy(*ORDER)


def search_many(corpus: DataFrame, queries: Iterable[Query], ordered: bool = False) -> DataFrame:
    """Several queries over one corpus; adds ``query_id`` (position in ``queries``).

    Queries the JVM answers (literals, line-safe regexes) share one scan and one pass;
    the others (Python route, empty queries) are added as their own branches."""
    from trawl.operators.batch import native_many

    queries = list(queries)
    if not queries:
        raise ValueError("no queries")
    native_ids = [i for i, q in enumerate(queries) if not q.is_empty and route(q) == "native"]
    parts = []
    if native_ids:
        shared = native_many(searchable(corpus), [queries[i] for i in native_ids])
        remap = F.element_at(F.array(*[F.lit(i) for i in native_ids]), F.col("query_id").cast("int") + 1)
        parts.append(shared.withColumn("query_id", remap.cast("long")).select("query_id", *FINDING_COLUMNS))
    for i, q in enumerate(queries):
        if i not in native_ids:
            parts.append(find(corpus, q).select(F.lit(i).cast("long").alias("query_id"), *FINDING_COLUMNS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("query_id", *ORDER) if ordered else out
