"""The registered queries: one per operator of the inventory, each with its oracle.

Each item has ``run(spark, sf_dir) -> DataFrame`` and, where SQL can state the same
result, ``sql`` for DuckDB over the pre-registered table views.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_sql as O
from trawl import Query, search
from trawl.sources import tables


@dataclass
class Item:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


CATALOG: dict[str, Item] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        CATALOG[name] = Item(fn, sql)
        return fn

    return deco


CORPUS = {"documents": tables.documents, "pages": tables.pages, "conversations": tables.conversations}


def _search(corpus: str, query: Query, ordered: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(CORPUS[corpus](spark, sf_dir), query, ordered=ordered)

    return run


def _search_item(name, corpus, query: Query, sql_kind: str | None, ordered: bool = False):
    sql = None
    if sql_kind == "literal":
        sql = O.literal_search(corpus, query.text, query.case_sensitive, query.context_lines)
    elif sql_kind == "line_regex":
        sql = O.line_regex_search(corpus, query.text, query.case_sensitive, query.context_lines)
    elif sql_kind == "text_regex":
        sql = O.text_regex_search(corpus, query.text, query.case_sensitive, query.context_lines)
    CATALOG[name] = Item(_search(corpus, query, ordered), O.wrap_findings(sql) if sql else None)


# ---------------------------------------------------------------- match operators
# P1, the flagship: the default mode (literal, case-insensitive, 3 lines of context).
# Report order (A3: path, line, column) is part of the flagship; the operator queries
# below return the same findings as an unordered set.
_search_item("search_documents", "documents", Query("license"), "literal", ordered=True)
_search_item("search_literal_ci", "documents", Query("the"), "literal")
_search_item("search_literal_cs", "documents", Query("The", case_sensitive=True), "literal")
_search_item("search_literal_metachars", "documents", Query(". The", case_sensitive=True), "literal")
_search_item("search_regex_cs", "documents", Query(r"qu[a-z]+", regex=True, case_sensitive=True), "line_regex")
_search_item("search_regex_ci", "documents", Query(r"th[aeiou][a-z]{2,4}", regex=True), "line_regex")
_search_item(
    "search_regex_multiline", "documents", Query(r"\.\s+[A-Z][a-z]", regex=True, case_sensitive=True), "text_regex"
)
CATALOG["search_regex_zero_width"] = Item(
    _search("documents", Query(r"(?=License)", regex=True, case_sensitive=True), False),
    O.wrap_findings(O.literal_search("documents", "License", True, 3, zero_width=True)),
)
# Python's Unicode \w is [\pL\pN_] in RE2; the leading \b is stated as "line start or a
# non-word character" kept outside the finding
CATALOG["search_regex_unicode_word"] = Item(
    _search("documents", Query(r"\bqu\w+", regex=True), False),
    O.wrap_findings(O.led_regex_search("documents", r"(?i)(?:^|[^\pL\pN_])(qu[\pL\pN_]+)")),
)
# Context windows of other sizes
_search_item("snippet_context", "documents", Query("license", context_lines=10), "literal")
_search_item("snippet_no_context", "documents", Query("license", context_lines=0), "literal")
# The same search over the other text tables
_search_item("search_pages", "pages", Query("the"), "literal")
_search_item("search_conversations", "conversations", Query("the"), "literal")


# an inline flag, and a repeat over alternatives (which stays off the JVM's recursive matcher)
CATALOG["search_regex_inline_flag"] = Item(
    _search("documents", Query(r"(?i)license", regex=True, case_sensitive=True), False),
    O.wrap_findings(O.literal_search("documents", "license")),
)
_search_item("search_regex_alternation", "documents", Query(r"(?:qu|th)+e", regex=True, case_sensitive=True), "line_regex")


@register(
    "docs_matching",
    "SELECT path, CAST((length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7 AS BIGINT) AS n "
    f"FROM ({O.CORPORA['documents']}) c WHERE contains(lower(text), 'license')",
)
def docs_matching(spark, sf_dir):
    """M9: documents that match at all, with their match count."""
    found = search(tables.documents(spark, sf_dir), Query("license"), ordered=False)
    return found.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- corpus filters
from trawl.operators import filters as FL  # noqa: E402

NO_RULES = FL.PathRules(excluded_dirs=(), excluded_files=(), binary_extensions=(), custom_patterns=(), exclude_dot_items=False)


def _tree_filter(rules: FL.PathRules):
    def run(spark, sf_dir):
        return FL.filter_paths(tables.document_tree(spark, sf_dir), rules).select("path")

    return run


CATALOG["filter_hidden"] = Item(
    _tree_filter(FL.PathRules(excluded_dirs=(), excluded_files=(), binary_extensions=())),
    O.tree_where(f"NOT ({O.HIDDEN})"),
)
CATALOG["filter_excluded_dirs"] = Item(
    _tree_filter(FL.PathRules(excluded_files=(), binary_extensions=(), exclude_dot_items=False)),
    O.tree_where(f"NOT ({O.EXCLUDED_DIR})"),
)
CATALOG["filter_excluded_globs"] = Item(
    _tree_filter(FL.PathRules(excluded_dirs=(), binary_extensions=(), exclude_dot_items=False)),
    O.tree_where(f"NOT {O.EXCLUDED_GLOB}"),
)
CATALOG["filter_binary_ext"] = Item(
    _tree_filter(FL.PathRules(excluded_dirs=(), excluded_files=(), exclude_dot_items=False)),
    O.tree_where(f"NOT ({O.BINARY_EXT})"),
)
# directory patterns: a name, 'dir/*' (also the dir itself), 'path/dir/' and a path
CATALOG["filter_custom_dirs"] = Item(
    _tree_filter(
        FL.PathRules(excluded_dirs=(), excluded_files=(), binary_extensions=(), exclude_dot_items=False,
                     custom_patterns=("src1", "src4/*", "src5/fr/", "src6/e?"))
    ),
    O.tree_where(
        "NOT (parts[1] IN ('src1', 'src4') OR (parts[1] = 'src5' AND parts[2] = 'fr') "
        "OR (parts[1] = 'src6' AND parts[2] LIKE 'e_' AND len(parts) > 2))"
    ),
)
# file patterns on the name or the relative path; 'x/' patterns are directory-only
# (custom patterns also prune directories, so 'fr/' removes every 'fr' folder)
CATALOG["filter_custom_files"] = Item(
    _tree_filter(
        FL.PathRules(excluded_dirs=(), excluded_files=(), binary_extensions=(), exclude_dot_items=False,
                     custom_patterns=("*.md", "src7/*/doc_1*", "fr/", "doc_2?.txt"))
    ),
    O.tree_where(
        "NOT (name LIKE '%.md' OR (rel LIKE 'src7/%/doc\\_1%' ESCAPE '\\') "
        "OR regexp_full_match(name, 'doc_2.\\.txt') OR parts[2] = 'fr')"
    ),
)
# F1-F6 together with the defaults: what a plain scan keeps
CATALOG["scan_filter"] = Item(
    _tree_filter(FL.PathRules()),
    O.tree_where(f"NOT ({O.HIDDEN}) AND NOT ({O.EXCLUDED_DIR}) AND NOT {O.EXCLUDED_GLOB} AND NOT ({O.BINARY_EXT})"),
)


@register(
    "filter_nontext_ratio",
    "SELECT path, "
    f"len(list_filter({O.utf8_probe_pairs('text')}, lambda b: b = '00')) > 0 AS has_nul, "
    f"CAST(len(list_filter({O.utf8_probe_pairs('text')}, lambda b: NOT regexp_matches(b, '{O.TEXT_BYTE_HEX}'))) AS DOUBLE) "
    f"/ greatest(len({O.utf8_probe_pairs('text')}), 1) > 0.30 AS mostly_nontext, "
    f"len(list_filter({O.utf8_probe_pairs('text')}, lambda b: b = '00')) > 0 OR CAST(len(list_filter({O.utf8_probe_pairs('text')}, "
    f"lambda b: NOT regexp_matches(b, '{O.TEXT_BYTE_HEX}'))) AS DOUBLE) / greatest(len({O.utf8_probe_pairs('text')}), 1) > 0.30 AS is_binary "
    f"FROM ({O.CORPORA['documents']}) c",
)
def filter_nontext_ratio(spark, sf_dir):
    """F7-F9 over the UTF-8 bytes of every document (non-Latin prose counts as binary)."""
    docs = tables.documents(spark, sf_dir)
    content = F.encode("text", "UTF-8")
    chunk = FL.probe(content)
    return docs.select(
        "path",
        FL.has_nul(chunk).alias("has_nul"),
        F.coalesce(FL.nontext_share(chunk) > FL.NONTEXT_RATIO, F.lit(False)).alias("mostly_nontext"),
        FL.binary_by_content(content).alias("is_binary"),
    )


@register(
    "decode_corpus",
    f"SELECT path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM ({O.CORPORA['documents']}) c",
)
def decode_corpus(spark, sf_dir):
    """S5 on the UTF-8 bytes of every document: valid UTF-8 decodes back to the text."""
    from trawl.sources.content import decode_text

    docs = tables.documents(spark, sf_dir)
    return docs.select("path", decode_text(F.encode("text", "UTF-8")).alias("text"))


# ---------------------------------------------------------------- reports
from trawl.operators import report as R  # noqa: E402

_LICENSE_SQL = O.literal_search("documents", "license")


def _license(spark, sf_dir):
    return search(tables.documents(spark, sf_dir), Query("license"), ordered=False)


@register("match_count", f"SELECT CAST(count(*) AS BIGINT) AS total_matches FROM ({O.literal_search('documents', 'the')}) f")
def match_count(spark, sf_dir):
    return R.match_count(search(tables.documents(spark, sf_dir), Query("the"), ordered=False))


@register("finding_ids", O.ordered_findings(_LICENSE_SQL))
def finding_ids(spark, sf_dir):
    return R.with_finding_ids(_license(spark, sf_dir))


@register(
    "report_roundtrip",
    "SELECT finding_id, file_path, line_number, match_text, char_start_in_line, char_end_in_line, snippet "
    f"FROM ({O.ordered_findings(_LICENSE_SQL)}) x",
)
def report_roundtrip(spark, sf_dir):
    """S7 + K1 + K6: a report written as JSON lines in many parts and read back with its ids."""
    from trawl.session import checkpoint_dir
    from trawl.sources.report import read_report_lines

    path = f"{checkpoint_dir(spark)}/trawl-report-{_uuid.uuid4().hex}"
    R.write_report(_license(spark, sf_dir), path, "jsonl")
    return read_report_lines(spark, path).select(
        "finding_id", "file_path", "line_number", "match_text", "char_start_in_line", "char_end_in_line", "snippet"
    )


@register("finding_lookup", f"SELECT * FROM ({O.ordered_findings(_LICENSE_SQL)}) x WHERE finding_id = 10")
def finding_lookup(spark, sf_dir):
    return R.lookup(R.with_finding_ids(_license(spark, sf_dir)), "10")


@register(
    "report_file_headers",
    "SELECT file_path, CAST(line_number AS BIGINT) AS line_number, CAST(char_start_in_line AS BIGINT) AS char_start_in_line, "
    "row_number() OVER (PARTITION BY file_path ORDER BY line_number, char_start_in_line) = 1 AS new_file "
    f"FROM ({O.literal_search('documents', 'the')}) f",
)
def report_file_headers(spark, sf_dir):
    """A2 on the materialized report (the search runs once)."""
    report = R.with_finding_ids(search(tables.documents(spark, sf_dir), Query("the"), ordered=False))
    return R.with_file_headers(report.select(*R.ORDER)).select(*R.ORDER, "new_file")


@register("finding_markdown", O.markdown_blocks(_LICENSE_SQL))
def finding_markdown(spark, sf_dir):
    return R.report_blocks(_license(spark, sf_dir), "md")


@register("finding_console", O.console_blocks(_LICENSE_SQL))
def finding_console(spark, sf_dir):
    return R.report_blocks(_license(spark, sf_dir), "console")


@register("finding_json", O.json_blocks(_LICENSE_SQL))
def finding_json(spark, sf_dir):
    """K1: exact ``json.dumps(indent=4)`` text, one element per row (ASCII-escaped)."""
    return R.report_blocks(_license(spark, sf_dir), "json")


@register(
    "files_per_root",
    "SELECT '/corpus/' || split_part(path, '/', 3) AS root, CAST(count(*) AS BIGINT) AS files "
    f"FROM ({O.tree_where(f'NOT ({O.HIDDEN}) AND NOT ({O.EXCLUDED_DIR}) AND NOT {O.EXCLUDED_GLOB} AND NOT ({O.BINARY_EXT})')}) x "
    "GROUP BY 1",
)
def files_per_root(spark, sf_dir):
    """A6 with one root per source folder: ``/corpus/<source>``."""
    tree = tables.document_tree(spark, sf_dir).withColumn("root", F.regexp_extract("path", r"^(/corpus/[^/]+)", 1))
    kept = FL.filter_paths(tree, FL.PathRules())
    return R.files_per_root(kept)


# ---------------------------------------------------------------- elaboration
from trawl.operators import elaborate as EL  # noqa: E402

_LICENSE_IDS_SQL = O.ordered_findings(_LICENSE_SQL)


def _license_ids(spark, sf_dir):
    return R.with_finding_ids(_license(spark, sf_dir))


@register(
    "elab_context",
    f"SELECT finding_id, has_content, file_context FROM ({O.elab_context(_LICENSE_IDS_SQL)}) x",
)
def elab_context(spark, sf_dir):
    """E1 + E3: each finding joined back to its document, ±10 numbered lines."""
    ctx = EL.context_lines(_license_ids(spark, sf_dir), tables.documents(spark, sf_dir), 10)
    return ctx.select("finding_id", "has_content", "file_context")


@register("elab_prompt", f"SELECT finding_id, context, prompt FROM ({O.elab_prompt(_LICENSE_IDS_SQL)}) x")
def elab_prompt(spark, sf_dir):
    """E4 + E5: context block (snippet + file window) and the prompt text."""
    return EL.prompts(_license_ids(spark, sf_dir), tables.documents(spark, sf_dir), 10).select("finding_id", "context", "prompt")


@register(
    "elab_missing_source",
    f"SELECT finding_id, context FROM ({O.elab_prompt(_LICENSE_IDS_SQL, 'pages')}) x",
)
def elab_missing_source(spark, sf_dir):
    """E1 left outer: the findings' files are not in this corpus -> snippet only."""
    return EL.prompts(_license_ids(spark, sf_dir), tables.pages(spark, sf_dir), 10).select("finding_id", "context")


@register(
    "elaborate_stub",
    f"SELECT finding_id, {O.stub_reply('prompt')} AS elaboration, 'ok' AS status FROM ({O.elab_prompt(_LICENSE_IDS_SQL)}) x",
)
def elaborate_stub(spark, sf_dir):
    """E6 + E9: bulk elaboration through a deterministic stand-in model."""
    return EL.elaborate(_license_ids(spark, sf_dir), tables.documents(spark, sf_dir), EL.stub_model, 10)


@register(
    "elab_errors",
    f"SELECT finding_id, {O.flaky_reply('prompt')} AS elaboration, "
    "CASE WHEN left(sha256(prompt), 1) IN ('0', '1', '2') THEN 'error' ELSE 'ok' END AS status "
    f"FROM ({O.elab_prompt(_LICENSE_IDS_SQL)}) x",
)
def elab_errors(spark, sf_dir):
    """No answer / blank answer / failed call become 'Error: ...' rows, never task failures."""
    return EL.elaborate(_license_ids(spark, sf_dir), tables.documents(spark, sf_dir), EL.flaky_stub_model, 10)


@register(
    "finding_validation",
    "SELECT finding_id, CASE WHEN char_start_in_line = 0 THEN FALSE ELSE TRUE END AS valid, "
    "CASE WHEN char_start_in_line = 0 THEN 'Error: Finding at index ' || CAST(finding_id AS VARCHAR) || "
    "' has an invalid structure. Missing one of [''file_path'', ''line_number'', ''snippet'', ''match_text''].' END AS error "
    f"FROM ({_LICENSE_IDS_SQL}) x",
)
def finding_validation(spark, sf_dir):
    """E8 on a damaged report: findings that start a line lose their snippet."""
    damaged = _license_ids(spark, sf_dir).withColumn(
        "snippet", F.when(F.col("char_start_in_line") == 0, F.lit(None)).otherwise(F.col("snippet"))
    )
    return EL.validate(damaged).select("finding_id", "valid", "error")


@register(
    "search_then_elaborate",
    f"SELECT finding_id, file_path, line_number, {O.stub_reply('prompt')} AS elaboration "
    f"FROM ({O.elab_prompt(_LICENSE_IDS_SQL)}) x",
)
def search_then_elaborate(spark, sf_dir):
    """Search -> report ids -> elaborate every finding -> findings with elaboration."""
    corpus = tables.documents(spark, sf_dir)
    ids = R.with_finding_ids(search(corpus, Query("license"), ordered=False))
    done = EL.elaborate(ids, corpus, EL.stub_model, 10)
    return ids.join(done, "finding_id").select("finding_id", "file_path", "line_number", "elaboration")


# ---------------------------------------------------------------- result tables
import datetime as _dt  # noqa: E402
import os  # noqa: E402

from trawl.operators import cache as C  # noqa: E402

T0 = _dt.datetime(2026, 1, 1, 0, 0, 0)
T1 = _dt.datetime(2026, 1, 1, 0, 10, 0)
_LICENSE = Query("license")


def _docs_v2(spark, sf_dir):
    """The same documents after an edit of every French text (mtime + 100 s)."""
    d = tables.documents(spark, sf_dir)
    lang = F.split("path", "/").getItem(3)
    return d.withColumn("mtime", F.col("mtime") + F.when(lang == "fr", F.lit(100.0)).otherwise(F.lit(0.0)))


@register(
    "cache_key",
    f"SELECT path, {O.file_key_sql('search', O.SEARCH_PARAMS_LICENSE, 'path', 'mtime')} AS key "
    f"FROM ({O.CORPORA['documents']}) c",
)
def cache_key(spark, sf_dir):
    """One key per (operation, parameters, file, mtime)."""
    d = tables.documents(spark, sf_dir)
    return d.select("path", C.file_key("search", _LICENSE.params(), F.col("path"), F.col("mtime")).alias("key"))


def _populated(spark, sf_dir, **kw):
    table = C.scratch_table(spark, "search", **kw)
    C.cached_search(tables.documents(spark, sf_dir), _LICENSE, table, now=T0).count()
    return table


@register("cache_hits", "SELECT path, lang IS DISTINCT FROM 'fr' AS hit FROM (" + O.DOCS_V2 + ") d")
def cache_hits(spark, sf_dir):
    """C2 + C5: after the edit, only the edited files miss."""
    table = _populated(spark, sf_dir)
    return C.lookup_keys(_docs_v2(spark, sf_dir), _LICENSE, table, now=T1).select("path", "hit")


@register("search_incremental", O.wrap_findings(_LICENSE_SQL))
def search_incremental(spark, sf_dir):
    """C4: the second search recomputes only edited files and reads the rest from the table."""
    table = _populated(spark, sf_dir)
    return C.cached_search(_docs_v2(spark, sf_dir), _LICENSE, table, now=T1)


@register("cache_ttl", f"SELECT path, lang IS NOT DISTINCT FROM 'fr' AS hit FROM ({O.DOCS_V2}) d")
def cache_ttl(spark, sf_dir):
    """With a TTL of one hour, two hours after the first search only what a second one stored 90 minutes
    later (the edited files) is still live."""
    table = _populated(spark, sf_dir, ttl_seconds=3600)
    edited = _docs_v2(spark, sf_dir)
    french = edited.where(F.split("path", "/").getItem(3) == "fr")
    C.cached_search(french, _LICENSE, table, now=T0 + _dt.timedelta(minutes=90))
    return C.lookup_keys(edited, _LICENSE, table, now=T0 + _dt.timedelta(hours=2)).select("path", "hit")


@register("cache_delete", f"SELECT path, split_part(path, '/', 3) <> 'src0' AS hit FROM ({O.CORPORA['documents']}) c")
def cache_delete(spark, sf_dir):
    """Deleting the keys of one source folder turns exactly those into misses."""
    table = _populated(spark, sf_dir)
    docs = tables.documents(spark, sf_dir)
    gone = docs.where(F.col("path").startswith("/corpus/src0/")).select(
        C.file_key("search", _LICENSE.params(), F.col("path"), F.col("mtime")).alias("key")
    )
    table.delete(gone)
    return C.lookup_keys(docs, _LICENSE, table, now=T1).select("path", "hit")


EVICT_LIMIT = 40_000


@register(
    "cache_evict",
    f"""
WITH f AS ({_LICENSE_SQL}),
sz AS (SELECT file_path, sum(length(snippet) + length(match_text) + length(file_path) + 32) AS b FROM f GROUP BY 1),
e1 AS (SELECT path, {O.file_key_sql('search', O.SEARCH_PARAMS_LICENSE, 'path', 'mtime')} AS key, 0 AS t, lang
       FROM ({O.CORPORA['documents']}) c JOIN (SELECT doc_id, lang FROM documents) l
       ON path LIKE '%/doc_' || CAST(l.doc_id AS VARCHAR) || '.txt'),
e2a AS (SELECT path, {O.file_key_sql('search', O.SEARCH_PARAMS_LICENSE, 'path', 'mtime')} AS key, 1 AS t
       FROM ({O.DOCS_V2}) d),
b1 AS (SELECT e1.path, e1.key, e1.t, coalesce(sz.b, 0) AS b FROM e1 LEFT JOIN sz ON sz.file_path = e1.path),
k1 AS (SELECT path, key, t, b FROM b1),
e2 AS (SELECT * FROM e2a WHERE key NOT IN (SELECT key FROM k1)),
b2 AS (SELECT e2.path, e2.key, e2.t, coalesce(sz.b, 0) AS b FROM e2 LEFT JOIN sz ON sz.file_path = e2.path),
eb AS (SELECT * FROM k1 UNION ALL SELECT * FROM b2),
r AS (SELECT *, sum(b) OVER (ORDER BY t DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM eb)
SELECT key, CAST(t AS BIGINT) AS batch FROM r WHERE running <= {EVICT_LIMIT}
""",
)
def cache_evict(spark, sf_dir):
    """A query over the entries finds those beyond the limit (the newest stay), and these are deleted
    (maintenance: the searches before it store and return everything)."""
    table = _populated(spark, sf_dir, size_limit_bytes=EVICT_LIMIT)
    C.cached_search(_docs_v2(spark, sf_dir), _LICENSE, table, now=T1).count()
    table.delete(table.beyond_limit())
    return table.entries().select("key", F.when(F.col("stored_at") == F.lit(T1), 1).otherwise(0).cast("long").alias("batch"))


@register(
    "elab_cache",
    f"SELECT finding_id, CASE WHEN left(sha256(prompt), 1) IN ('0', '1', '2') THEN 'error' ELSE 'ok' END AS status, "
    f"left(sha256(prompt), 1) NOT IN ('0', '1', '2') AS from_cache FROM ({O.elab_prompt(_LICENSE_IDS_SQL)}) x",
)
def elab_cache(spark, sf_dir):
    """The second elaboration run reads every stored answer; errors were not stored
    and are asked again."""
    corpus = tables.documents(spark, sf_dir)
    ids = _license_ids(spark, sf_dir)
    table = C.scratch_table(spark, "elaborate")
    C.cached_elaborate(ids, corpus, EL.flaky_stub_model, table, now=T0).count()
    return C.cached_elaborate(ids, corpus, EL.flaky_stub_model, table, now=T1).select("finding_id", "status", "from_cache")


# ---------------------------------------------------------------- file source
import uuid as _uuid  # noqa: E402

from trawl.sources import files as FS  # noqa: E402


def _local_dir(spark) -> str:
    from trawl.session import checkpoint_dir

    d = checkpoint_dir(spark)
    return d[len("file:"):] if d.startswith("file:") else d


@register(
    "scan_files",
    O.tree_where(
        f"NOT ({O.HIDDEN}) AND NOT ({O.EXCLUDED_DIR}) AND NOT {O.EXCLUDED_GLOB} AND NOT ({O.BINARY_EXT}) AND NOT ("
        f"len(list_filter({O.utf8_probe_pairs('text')}, lambda b: b = '00')) > 0 OR "
        f"(length(text) > 0 AND CAST(len(list_filter({O.utf8_probe_pairs('text')}, lambda b: NOT regexp_matches(b, "
        f"'{O.TEXT_BYTE_HEX}'))) AS DOUBLE) / len({O.utf8_probe_pairs('text')}) > 0.30))"
    ),
)
def scan_files(spark, sf_dir):
    """S1-S4 + F1-F9 on real files: ``documents`` written out as the synthetic tree,
    then listed level by level, pruned, probed and de-duplicated."""
    base = os.path.join(_local_dir(spark), f"tree-{_uuid.uuid4().hex}")
    tree = tables.document_tree(spark, sf_dir)
    FS.write_tree(tree, base)
    found = FS.scan(spark, [os.path.join(base, "corpus")])
    return found.select(F.concat(F.lit("/corpus/"), F.expr(f"substring(path, {len(base) + len('/corpus/') + 1})")).alias("path"))


# ---------------------------------------------------------------- streaming
from trawl.streaming.search_stream import corpus_stream, run_until_caught_up  # noqa: E402


@register("search_stream", O.wrap_findings(_LICENSE_SQL))
def search_stream(spark, sf_dir):
    """The incremental search as a stream: the documents table read by a file-stream
    source, searched per micro-batch, appended to a findings table."""
    from trawl.session import checkpoint_dir

    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{_uuid.uuid4().hex}"
    schema = tables.table(spark, sf_dir, "documents").schema
    docs = corpus_stream(
        spark, f"{sf_dir}/documents.parquet", schema, lambda raw: raw.select(tables.document_path().alias("path"), "text")
    )
    return run_until_caught_up(docs, _LICENSE, f"{base}/findings", f"{base}/_checkpoint")


# ---------------------------------------------------------------- query batches
from trawl import search_many  # noqa: E402

BATCH = [Query("license"), Query("The", case_sensitive=True), Query(r"qu[a-z]+", regex=True, case_sensitive=True)]


@register(
    "search_batch",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS query_id, {O.FINDING_SELECT} FROM ({sql}) f{i}"
        for i, sql in enumerate(
            [
                O.literal_search("documents", "license"),
                O.literal_search("documents", "The", True),
                O.line_regex_search("documents", r"qu[a-z]+", True),
            ]
        )
    ),
)
def search_batch(spark, sf_dir):
    """Several queries over one corpus, tagged with their position in the batch."""
    return search_many(tables.documents(spark, sf_dir), BATCH)


from trawl import search_query_table  # noqa: E402


@register(
    "search_query_table",
    O.query_table_search("documents", "SELECT item_id AS query_id, text AS query FROM benchmark"),
)
def search_query_table_(spark, sf_dir):
    """Every passage of ``benchmark`` as a literal query over all documents, in one pass."""
    asked = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search_query_table(tables.documents(spark, sf_dir), asked)


@register("search_chunked", O.wrap_findings(O.literal_search("documents", "the")))
def search_chunked_(spark, sf_dir):
    """M2, M7, M8 and N1-N4 with every text cut into chunks of 1,024 bytes, each a row of its own."""
    from trawl.operators.chunked import search_chunked

    return search_chunked(tables.documents(spark, sf_dir), Query("the"), chunk_bytes=1024)


# ---------------------------------------------------------------- more single-operator checks


@register(
    "filter_nul_bytes",
    "SELECT path, CASE WHEN doc_id % 3 = 0 THEN strlen(text) < 1024 ELSE doc_id % 3 = 1 AND length(text) > 0 END AS has_nul "
    f"FROM (SELECT {O.DOCUMENT_PATH} AS path, coalesce(doc_id, 2) AS doc_id, coalesce(text, '') AS text FROM documents) d",
)
def filter_nul_bytes(spark, sf_dir):
    """a third of the documents end in a NUL byte (seen in texts of under 1,024 bytes), a third begin with one."""
    docs = tables.table(spark, sf_dir, "documents")
    raw, nul, third = F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("00")), F.coalesce("doc_id", F.lit(2)) % 3
    content = F.when(third == 0, F.concat(raw, nul)).when((third == 1) & (F.length(raw) > 0), F.concat(nul, raw)).otherwise(raw)
    return docs.select(tables.document_path().alias("path"), FL.has_nul(FL.probe(content)).alias("has_nul"))


@register(
    "corpus_dedup_sorted",
    f"SELECT path, '/corpus' AS root, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS position FROM (SELECT DISTINCT path FROM ({O.TREE}) t) x",
)
def corpus_dedup_sorted(spark, sf_dir):
    """The tree listed from ``/corpus`` and again from each source's folder, then once per path and sorted."""
    tree = tables.document_tree(spark, sf_dir).select("path", "root", "mtime")
    again = tree.withColumn("root", F.regexp_extract("path", "^(/corpus/[^/]+)", 1))
    return FS.dedupe_sorted(tree.union(again)).select("path", "root", "position")



@register("mtime_default", f"SELECT path, CAST(0.0 AS DOUBLE) AS mtime FROM ({O.CORPORA['documents']}) c")
def mtime_default(spark, sf_dir):
    """The synthetic document paths do not exist as files, so every mtime is 0.0."""
    return FS.stamp_paths(tables.documents(spark, sf_dir))


@register("search_no_cache", O.wrap_findings(_LICENSE_SQL))
def search_no_cache(spark, sf_dir):
    """With the cache bypassed the table is neither read nor written."""
    return C.cached_search(tables.documents(spark, sf_dir), _LICENSE, None, use_cache=False)


@register(
    "elaboration_json",
    "SELECT finding_id, '{' || chr(10) || '    \"elaboration\": \"' || "
    f"{O.stub_reply('prompt')} || '\"' || chr(10) || '}}' AS elaboration_json "
    f"FROM ({O.elab_prompt(_LICENSE_IDS_SQL)}) x",
)
def elaboration_json(spark, sf_dir):
    """K5: each elaboration as ``json.dumps({"elaboration": ...}, indent=4)``."""
    done = EL.elaborate(_license_ids(spark, sf_dir), tables.documents(spark, sf_dir), EL.stub_model, 10)
    return R.elaboration_json(done).select("finding_id", "elaboration_json")


@register(
    "decode_latin1_fallback",
    "SELECT path, array_to_string(list_transform(regexp_extract_all(hex(encode(text)) || 'FF', '..'), "
    "lambda b: chr(CAST('0x' || b AS INTEGER))), '') AS text "
    f"FROM ({O.CORPORA['documents']}) c",
)
def decode_latin1_fallback(spark, sf_dir):
    """S5 fallback: every document's UTF-8 bytes plus one 0xFF byte are not valid UTF-8,
    so they decode as ISO-8859-1, one character per byte."""
    from trawl.sources.content import decode_text

    docs = tables.documents(spark, sf_dir)
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))
    return docs.select("path", decode_text(raw).alias("text"))


@register(
    "elab_relative_paths",
    f"SELECT finding_id, has_content, file_context FROM ({O.elab_context(_LICENSE_IDS_SQL)}) x",
)
def elab_relative_paths(spark, sf_dir):
    """A report whose paths are relative to its folder (``/corpus``); they are
    resolved against that folder before the findings meet their sources."""
    ids = _license_ids(spark, sf_dir).withColumn("file_path", F.expr("substring(file_path, 9)"))
    corpus = tables.documents(spark, sf_dir)
    resolved = EL.resolve_report_paths(ids, "/corpus", corpus)
    return EL.context_lines(resolved, corpus, 10).select("finding_id", "has_content", "file_context")


# ---------------------------------------------------------------- rules as a table, indexed corpora
_RULES_SQL = """
SELECT doc_id AS rule_id, 'file' AS kind, 'doc_' || CAST(doc_id AS VARCHAR) || '.[tm]*' AS pattern FROM labels WHERE quality = 0
UNION ALL SELECT doc_id, 'custom', '*/fr/doc_' || CAST(doc_id AS VARCHAR) || '.*' FROM labels WHERE toxic = 1
UNION ALL SELECT min(doc_id), 'dir', source FROM documents GROUP BY source HAVING min(doc_id) % 5 = 0
UNION ALL SELECT min(doc_id), 'custom', source || '/e?/' FROM documents GROUP BY source HAVING min(doc_id) % 5 = 1
"""


@register(
    "filter_rule_table",
    f"""
WITH rules AS ({_RULES_SQL}),
split AS (SELECT path, rel, string_split(rel, '/') AS parts FROM ({O.TREE}) t),
tree AS (SELECT path, rel, parts, parts[-1] AS name, list_transform(range(1, len(parts)), lambda i: array_to_string(parts[1:i], '/')) AS dirs FROM split),
hit AS (
  SELECT path, min(rule_id) AS rule_id FROM tree, rules
  WHERE CASE kind WHEN 'dir' THEN list_contains(parts[1:len(parts) - 1], pattern)
    WHEN 'file' THEN name GLOB pattern
    ELSE len(list_filter(dirs, lambda d: d GLOB rtrim(pattern, '/') OR string_split(d, '/')[-1] GLOB rtrim(pattern, '/'))) > 0
      OR (NOT ends_with(pattern, '/') AND (rel GLOB pattern OR name GLOB pattern)) END
  GROUP BY path)
SELECT tree.path, CAST(rule_id AS BIGINT) AS excluded_by FROM tree LEFT JOIN hit USING (path)
""",
)
def filter_rule_table(spark, sf_dir):
    """A table of rules (globs for the files of documents labelled poor or toxic, some sources' folders) over the
    whole tree: for every path the first rule that excludes it."""
    from trawl.operators.rule_table import with_excluding_rule

    named = _RULES_SQL.replace("FROM labels", "FROM {labels}").replace("FROM documents", "FROM {documents}").replace("VARCHAR", "STRING")
    rules = spark.sql(named, labels=tables.table(spark, sf_dir, "labels"), documents=tables.table(spark, sf_dir, "documents"))
    return with_excluding_rule(tables.document_tree(spark, sf_dir), rules).select("path", "excluded_by")


_INDEXED = Query(r"licen[sc]e|warrant(?:y|ies)|copyright", regex=True)


@register(
    "docs_matching_indexed",
    "SELECT path, CAST(len(regexp_extract_all(lower(text), 'licen[sc]e|warrant(?:y|ies)|copyright')) AS BIGINT) AS n "
    f"FROM ({O.CORPORA['documents']}) c WHERE regexp_matches(lower(text), 'licen[sc]e|warrant(?:y|ies)|copyright')",
)
def docs_matching_indexed(spark, sf_dir):
    """M9: the corpus is written with its trigram postings; a Boolean trigram query picks the documents to read."""
    from trawl.operators.trigram_index import build_index, find_indexed
    from trawl.session import checkpoint_dir

    folder = f"{checkpoint_dir(spark).rstrip('/')}/trawl-index-{_uuid.uuid4().hex}"
    build_index(tables.documents(spark, sf_dir), folder)
    found = find_indexed(spark, folder, _INDEXED)
    return found.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
