"""DuckDB SQL that states each registered query's meaning independently of Spark.

Used by ``__spark_entry__.oracle_sql()``: the driver runs these over the same Parquet
tables (pre-registered as views) and compares them with the Spark results.  The SQL
works on whole tables; nothing here samples or caps rows.
"""

from __future__ import annotations

NL = "chr(10)"

# Python's str.splitlines() boundaries, in RE2 syntax.
SPLITLINES_RE2 = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
MISMATCH = "[Error: Could not generate snippet due to line number mismatch]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# --------------------------------------------------------------------------- corpora

DOCUMENT_PATH = (
    "'/corpus/' || coalesce(source, '_') || '/' || coalesce(lang, '_') || '/doc_' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.txt'"
)

CORPORA = {
    "documents": f"SELECT {DOCUMENT_PATH} AS path, text, CAST(doc_id AS DOUBLE) AS mtime FROM documents",
    "pages": "SELECT coalesce(url, '/pages/' || coalesce(CAST(page_id AS VARCHAR), '_') || '.html') AS path, html AS text, CAST(page_id AS DOUBLE) AS mtime FROM pages",
    "conversations": (
        "SELECT '/conversations/' || coalesce(CAST(conv_id AS VARCHAR), '_') || '/' || coalesce(CAST(turn AS VARCHAR), '_') || '.txt' AS path, "
        "text, CAST(conv_id AS DOUBLE) AS mtime FROM conversations"
    ),
}


def splitlines(expr: str) -> str:
    arr = f"regexp_split_to_array({expr}, {q(SPLITLINES_RE2)})"
    return f"(CASE WHEN {arr}[-1] = '' THEN {arr}[1:len({arr}) - 1] ELSE {arr} END)"


def snippet(sl: str, li: str, start: str, end: str, context: int) -> str:
    """Snippet text from the splitlines array ``sl``, 0-based line ``li``, offsets."""
    line = f"{sl}[{li} + 1]"
    b = f"least({end}, length({line}))"
    a = f"least({start}, {b})"
    hl = f"(left({line}, {a}) || '>>>' || substring({line}, {a} + 1, {b} - {a}) || '<<<' || substring({line}, {b} + 1))"
    body = (
        f"array_to_string(list_transform(range(greatest({li} - {context}, 0), least(len({sl}), {li} + {context} + 1)), "
        f"lambda j: printf('%4d: ', j + 1) || CASE WHEN j = {li} THEN {hl} ELSE {sl}[j + 1] END), {NL})"
    )
    return f"(CASE WHEN {li} < len({sl}) THEN {body} ELSE {q(MISMATCH)} END)"


FINDING_SELECT = (
    "file_path, CAST(line_number AS BIGINT) AS line_number, match_text, "
    "CAST(char_start_in_line AS BIGINT) AS char_start_in_line, "
    "CAST(char_end_in_line AS BIGINT) AS char_end_in_line, snippet"
)


def literal_search(corpus: str, text: str, case_sensitive: bool = False, context: int = 3, zero_width: bool = False) -> str:
    """Findings of a literal (no newline, lower() keeps its length) over a corpus.

    ``zero_width``: the findings of a look-ahead for that literal instead (same
    positions, empty match text, empty highlight)."""
    needle = text if case_sensitive else text.lower()
    hay = "text" if case_sensitive else "lower(text)"
    probe = "ol" if case_sensitive else "ll"
    return f"""
WITH docs AS (
  SELECT path, text FROM ({CORPORA[corpus]}) c
  WHERE text IS NOT NULL AND length(text) > 0 AND contains({hay}, {q(needle)})
), lined AS (
  SELECT path, string_split(text, {NL}) AS ol, string_split({hay}, {NL}) AS ll, {splitlines('text')} AS sl FROM docs
), numbered AS (
  SELECT path, ol, ll, sl, unnest(range(len(ol))) AS li FROM lined
), hit AS (
  SELECT path, sl, li, ol[li + 1] AS line, string_split({probe}[li + 1], {q(needle)}) AS pc
  FROM numbered WHERE contains({probe}[li + 1], {q(needle)})
), occ AS (
  SELECT path, sl, li, line, pc, unnest(range(1, len(pc))) AS k FROM hit
), pos AS (
  SELECT path, sl, li, line,
         CAST(list_sum(list_transform(pc[1:k], lambda x: length(x))) + (k - 1) * {len(text)} AS BIGINT) AS s
  FROM occ
)
SELECT path AS file_path, li + 1 AS line_number, {"''" if zero_width else f"substring(line, s + 1, {len(text)})"} AS match_text,
       s AS char_start_in_line, {"s" if zero_width else f"s + length(substring(line, s + 1, {len(text)}))"} AS char_end_in_line,
       {snippet('sl', 'li', 's', 's' if zero_width else 's + length(substring(line, s + 1, ' + str(len(text)) + '))', context)} AS snippet
FROM pos
"""


def query_table_search(corpus: str, queries: str, context: int = 3) -> str:
    """Findings of every literal of ``queries`` (query_id, query), case-insensitive, over a corpus; queries may hold
    newlines (lower() keeps their lengths)."""
    return f"""
WITH occ AS (
  SELECT query_id, path, text, length(query) AS n, string_split(lower(text), lower(query)) AS pc
  FROM ({CORPORA[corpus]}) c JOIN ({queries}) b ON length(query) > 0 AND contains(lower(text), lower(query))
), each AS (
  SELECT query_id, path, text, n, pc, unnest(range(1, len(pc))) AS k FROM occ
), pos AS (
  SELECT query_id, path, text, n, CAST(list_sum(list_transform(pc[1:k], lambda x: length(x))) + (k - 1) * n AS BIGINT) AS p FROM each
), spot AS (
  SELECT query_id, path, {splitlines('text')} AS sl, substring(text, p + 1, n) AS match_text,
         len(string_split(left(text, p), {NL})) - 1 AS li, length(string_split(left(text, p), {NL})[-1]) AS s, n
  FROM pos
)
SELECT CAST(query_id AS BIGINT) AS query_id, path AS file_path, CAST(li + 1 AS BIGINT) AS line_number, match_text,
       CAST(s AS BIGINT) AS char_start_in_line, CAST(s + n AS BIGINT) AS char_end_in_line,
       {snippet('sl', 'li', 's', 's + n', context)} AS snippet
FROM spot
"""


def line_regex_search(corpus: str, pattern: str, case_sensitive: bool = True, context: int = 3) -> str:
    """Findings of a regex that cannot match a newline or the empty string (RE2 = Python here)."""
    p = pattern if case_sensitive else "(?i)" + pattern
    return f"""
WITH docs AS (
  SELECT path, text FROM ({CORPORA[corpus]}) c
  WHERE text IS NOT NULL AND length(text) > 0 AND regexp_matches(text, {q(p)})
), lined AS (
  SELECT path, string_split(text, {NL}) AS ol, {splitlines('text')} AS sl FROM docs
), numbered AS (
  SELECT path, ol, sl, unnest(range(len(ol))) AS li FROM lined
), hit AS (
  SELECT path, sl, li, ol[li + 1] AS line,
         regexp_extract_all(ol[li + 1], {q(p)}) AS fd, regexp_split_to_array(ol[li + 1], {q(p)}) AS pc
  FROM numbered WHERE regexp_matches(ol[li + 1], {q(p)})
), occ AS (
  SELECT path, sl, li, line, fd, pc, unnest(range(1, len(fd) + 1)) AS k FROM hit
), pos AS (
  SELECT path, sl, li, fd[k] AS m,
         CAST(list_sum(list_transform(pc[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(fd[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM occ
)
SELECT path AS file_path, li + 1 AS line_number, m AS match_text, s AS char_start_in_line,
       s + length(m) AS char_end_in_line, {snippet('sl', 'li', 's', 's + length(m)', context)} AS snippet
FROM pos
"""


def text_regex_search(corpus: str, pattern: str, case_sensitive: bool = True, context: int = 3) -> str:
    """Findings of a regex over whole texts (matches may span lines), non-empty matches."""
    p = pattern if case_sensitive else "(?i)" + pattern
    return f"""
WITH docs AS (
  SELECT path, text FROM ({CORPORA[corpus]}) c
  WHERE text IS NOT NULL AND length(text) > 0 AND regexp_matches(text, {q(p)})
), parts AS (
  SELECT path, text, {splitlines('text')} AS sl,
         regexp_extract_all(text, {q(p)}) AS fd, regexp_split_to_array(text, {q(p)}) AS pc
  FROM docs
), occ AS (
  SELECT path, text, sl, fd, pc, unnest(range(1, len(fd) + 1)) AS k FROM parts
), abs AS (
  SELECT path, sl, fd[k] AS m,
         left(text, CAST(list_sum(list_transform(pc[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(fd[1:k - 1], lambda x: length(x))), 0) AS BIGINT)) AS before
  FROM occ
), pos AS (
  SELECT path, sl, m, CAST(length(before) - length(replace(before, {NL}, '')) AS BIGINT) AS li,
         CAST(length(string_split(before, {NL})[-1]) AS BIGINT) AS s
  FROM abs
)
SELECT path AS file_path, li + 1 AS line_number, m AS match_text, s AS char_start_in_line,
       s + length(m) AS char_end_in_line, {snippet('sl', 'li', 's', 's + length(m)', context)} AS snippet
FROM pos
"""


def wrap_findings(inner: str) -> str:
    return f"SELECT {FINDING_SELECT} FROM ({inner}) f"


# --------------------------------------------------------------------------- path rules

TREE_PATH = (
    "'/corpus/' || coalesce(source, '_') || '/' || CASE lang WHEN 'de' THEN '.de' WHEN 'es' THEN 'node_modules' ELSE coalesce(lang, '_') END"
    " || '/doc_' || coalesce(CAST(doc_id AS VARCHAR), '_') || '.' || CASE source WHEN 'src0' THEN 'log' WHEN 'src1' THEN 'PDF'"
    " WHEN 'src2' THEN 'tmp' WHEN 'src3' THEN 'md' ELSE 'txt' END"
)
TREE = f"SELECT {TREE_PATH} AS path, substring({TREE_PATH}, 9) AS rel, coalesce(text, '') AS text FROM documents"


def tree_where(cond: str) -> str:
    """Paths of the synthetic tree that satisfy ``cond`` (over ``path``, ``rel``, ``parts``, ``name``)."""
    return (
        "SELECT path FROM (SELECT path, rel, string_split(rel, '/') AS parts, "
        "string_split(rel, '/')[-1] AS name, text FROM (" + TREE + ") t0) t WHERE " + cond
    )


HIDDEN = "len(list_filter(parts, lambda p: starts_with(p, '.') AND p NOT IN ('.', '..'))) > 0"
EXCLUDED_DIR = "len(list_filter(parts[1:len(parts) - 1], lambda p: p IN ('.git', '__pycache__', 'venv', 'node_modules', '.hg', '.svn'))) > 0"
EXCLUDED_GLOB = "(name LIKE '%.log' OR name LIKE '%.tmp' OR name LIKE '%.swp' OR name LIKE '%.bak')"
BINARY_EXT = (
    "lower(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1)) IN ('.pyc', '.pyo', '.o', '.so', '.obj', '.dll', "
    "'.exe', '.class', '.jar', '.zip', '.tar', '.gz', '.bz2', '.rar', '.7z', '.iso', '.png', '.jpg', '.jpeg', "
    "'.gif', '.bmp', '.tiff', '.ico', '.mp3', '.wav', '.ogg', '.mp4', '.avi', '.mov', '.flv', '.mkv', '.pdf', "
    "'.doc', '.docx', '.xls', '.xlsx', '.ppt', '.pptx', '.odt', '.db', '.sqlite', '.dat')"
)


# --------------------------------------------------------------------------- content probes

def utf8_probe_pairs(text_expr: str) -> str:
    """The first 1,024 bytes of the UTF-8 encoding, as a list of two-digit hex strings."""
    return f"regexp_extract_all(left(hex(encode({text_expr})), 2048), '..')"


TEXT_BYTE_HEX = "^(2[0-9A-F]|[3-6][0-9A-F]|7[0-9A-E]|0A|0D|09|08)$"


# --------------------------------------------------------------------------- reports

def ordered_findings(inner: str) -> str:
    """Findings with their 0-based report position ``finding_id``."""
    return (
        "SELECT CAST(row_number() OVER (ORDER BY file_path, line_number, char_start_in_line) - 1 AS BIGINT) "
        f"AS finding_id, {FINDING_SELECT} FROM ({inner}) f"
    )


def markdown_blocks(inner: str) -> str:
    return f"""
WITH f AS ({ordered_findings(inner)}), n AS (SELECT count(*) AS total FROM f),
g AS (SELECT f.*, row_number() OVER (PARTITION BY file_path ORDER BY line_number, char_start_in_line) = 1 AS new_file FROM f)
SELECT finding_id,
  CASE WHEN finding_id = 0 THEN '# Code Search Results' || chr(10) || chr(10) || 'Found ' || CAST(total AS VARCHAR)
       || ' match(es) in total.' || chr(10) ELSE '' END
  || CASE WHEN new_file THEN CASE WHEN finding_id > 0 THEN chr(10) || '---' || chr(10) ELSE '' END
       || chr(10) || '## File: `' || file_path || '`' || chr(10) ELSE '' END
  || chr(10) || '### Match at Line ' || CAST(line_number AS VARCHAR) || chr(10) || '```text' || chr(10)
  || snippet || chr(10) || '```' AS value
FROM g, n
"""


def console_blocks(inner: str) -> str:
    return f"""
WITH f AS ({ordered_findings(inner)}), n AS (SELECT count(*) AS total FROM f)
SELECT finding_id,
  chr(10) || 'Match in: ' || file_path || chr(10) || 'Line ' || CAST(line_number AS VARCHAR) || ':' || chr(10) || snippet
  || CASE WHEN finding_id = total - 1 THEN chr(10) || chr(10) || 'Found ' || CAST(total AS VARCHAR)
       || ' match(es) in total.' ELSE '' END AS value
FROM f, n
"""


# --------------------------------------------------------------------------- elaboration

def elab_context(findings_with_ids: str, corpus: str = "documents", window: int = 10) -> str:
    """finding_id, file_path, line_number, snippet, has_content, file_context."""
    return f"""
WITH f AS ({findings_with_ids}),
src AS (SELECT path, text, {splitlines('text')} AS sl FROM ({CORPORA[corpus]}) c WHERE path IN (SELECT file_path FROM f))
SELECT f.finding_id, f.file_path, f.line_number, f.snippet, f.match_text,
       coalesce(length(src.text) > 0, FALSE) AS has_content,
       coalesce(array_to_string(list_transform(
           range(greatest(CAST(f.line_number AS BIGINT) - 1 - {window}, 0),
                 least(len(src.sl), CAST(f.line_number AS BIGINT) - 1 + {window} + 1)),
           lambda j: CASE WHEN j = f.line_number - 1 THEN '>> ' ELSE '  ' END || printf('%4d: ', j + 1) || src.sl[j + 1]),
         chr(10)), '') AS file_context
FROM f LEFT JOIN src ON src.path = f.file_path
"""


def elab_prompt(findings_with_ids: str, corpus: str = "documents", window: int = 10) -> str:
    from trawl.operators.elaborate import CONTEXT_HEAD, CONTEXT_TAIL, PROMPT_BODY, PROMPT_HEAD, SNIPPET_HEAD, SNIPPET_TAIL

    return f"""
WITH x AS ({elab_context(findings_with_ids, corpus, window)}),
y AS (SELECT x.*, CASE WHEN has_content THEN {q(SNIPPET_HEAD)} || snippet || {q(SNIPPET_TAIL)} || {q(CONTEXT_HEAD)}
        || file_context || {q(CONTEXT_TAIL)} ELSE snippet END AS context FROM x)
SELECT y.*, {q(PROMPT_HEAD)} || file_path || chr(10) || 'Line: ' || CAST(line_number AS VARCHAR) || chr(10) || chr(10)
       || 'Context/Code:' || chr(10) || context || {q(PROMPT_BODY)} AS prompt
FROM y
"""


def stub_reply(prompt: str) -> str:
    return f"'Elaboration ' || left(sha256({prompt}), 16) || ' (' || CAST(length({prompt}) AS VARCHAR) || ' chars)'"


def flaky_reply(prompt: str) -> str:
    from trawl.operators.elaborate import ERR_EMPTY, ERR_NO_CHOICES

    h = f"left(sha256({prompt}), 1)"
    return (
        f"CASE {h} WHEN '0' THEN {q(ERR_NO_CHOICES)} WHEN '1' THEN {q(ERR_EMPTY)} "
        "WHEN '2' THEN 'Error: API error during elaboration for ' || file_path || ':' || CAST(line_number AS VARCHAR) "
        f"|| ' (model): RuntimeError - stub failure' ELSE {stub_reply(prompt)} END"
    )


# --------------------------------------------------------------------------- result tables

SEARCH_PARAMS_LICENSE = '{"context_lines": 3, "is_case_sensitive": false, "is_regex": false, "query": "license"}'


def file_key_sql(op: str, params_json: str, path: str, mtime: str) -> str:
    return (
        f"sha256(concat_ws(chr(31), {q(op)}, {q(params_json)}, {path}, "
        f"CAST(CAST(round(coalesce({mtime}, 0.0) * 1000000) AS BIGINT) AS VARCHAR)))"
    )


DOCS_V2 = (
    f"SELECT {DOCUMENT_PATH} AS path, text, lang, source, "
    "CAST(doc_id AS DOUBLE) + CASE WHEN lang = 'fr' THEN 100.0 ELSE 0.0 END AS mtime FROM documents"
)


def led_regex_search(corpus: str, pattern: str, context: int = 3) -> str:
    """Findings of a line-safe regex written as ``(?:^|<lead char>)(<match>)`` in RE2: the
    full match may start with one lead character that is not part of the finding
    (how a leading ``\\b`` is stated without look-behind)."""
    return f"""
WITH docs AS (
  SELECT path, text FROM ({CORPORA[corpus]}) c
  WHERE text IS NOT NULL AND length(text) > 0 AND regexp_matches(text, {q(pattern)})
), lined AS (
  SELECT path, string_split(text, {NL}) AS ol, {splitlines('text')} AS sl FROM docs
), numbered AS (
  SELECT path, ol, sl, unnest(range(len(ol))) AS li FROM lined
), hit AS (
  SELECT path, sl, li, regexp_extract_all(ol[li + 1], {q(pattern)}, 0) AS fd, regexp_extract_all(ol[li + 1], {q(pattern)}, 1) AS g,
         regexp_split_to_array(ol[li + 1], {q(pattern)}) AS pc
  FROM numbered WHERE regexp_matches(ol[li + 1], {q(pattern)})
), occ AS (
  SELECT path, sl, li, fd, g, pc, unnest(range(1, len(fd) + 1)) AS k FROM hit
), pos AS (
  SELECT path, sl, li, g[k] AS m,
         CAST(list_sum(list_transform(pc[1:k], lambda x: length(x)))
              + coalesce(list_sum(list_transform(fd[1:k - 1], lambda x: length(x))), 0)
              + length(fd[k]) - length(g[k]) AS BIGINT) AS s
  FROM occ
)
SELECT path AS file_path, li + 1 AS line_number, m AS match_text, s AS char_start_in_line,
       s + length(m) AS char_end_in_line, {snippet('sl', 'li', 's', 's + length(m)', context)} AS snippet
FROM pos
"""


def json_string(expr: str) -> str:
    """Python ``json.dumps`` of a string (ASCII-escaped), in SQL (chr(92) is a backslash)."""
    c = "unicode(ch)"
    bs = "chr(92)"
    esc = (
        f"CASE WHEN {c} = 34 THEN {bs} || chr(34) WHEN {c} = 92 THEN {bs} || {bs} "
        f"WHEN {c} = 10 THEN {bs} || 'n' WHEN {c} = 13 THEN {bs} || 'r' WHEN {c} = 9 THEN {bs} || 't' "
        f"WHEN {c} = 8 THEN {bs} || 'b' WHEN {c} = 12 THEN {bs} || 'f' "
        f"WHEN {c} < 32 THEN {bs} || printf('u%04x', {c}) WHEN {c} < 128 THEN ch "
        f"WHEN {c} < 65536 THEN {bs} || printf('u%04x', {c}) "
        f"ELSE {bs} || printf('u%04x', 55296 + (({c} - 65536) >> 10)) || {bs} || printf('u%04x', 56320 + (({c} - 65536) & 1023)) END"
    )
    return f"(chr(34) || array_to_string(list_transform(string_split({expr}, ''), lambda ch: {esc}), '') || chr(34))"


def json_blocks(inner: str) -> str:
    nl = "chr(10)"
    fields = [
        ("file_path", json_string("file_path")),
        ("line_number", "CAST(line_number AS VARCHAR)"),
        ("match_text", json_string("match_text")),
        ("char_start_in_line", "CAST(char_start_in_line AS VARCHAR)"),
        ("char_end_in_line", "CAST(char_end_in_line AS VARCHAR)"),
        ("snippet", json_string("snippet")),
    ]
    body = f" || ',' || {nl} || ".join(f"'        \"{k}\": ' || {v}" for k, v in fields)
    return f"""
WITH f AS ({ordered_findings(inner)}), n AS (SELECT count(*) AS total FROM f)
SELECT finding_id,
  CASE WHEN finding_id = 0 THEN '[' || {nl} ELSE '' END || '    {{' || {nl} || {body} || {nl} || '    }}'
  || CASE WHEN finding_id = total - 1 THEN {nl} || ']' ELSE ',' END AS value
FROM f, n
"""
