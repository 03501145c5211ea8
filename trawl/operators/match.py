"""Match operators: every occurrence of a query in every document, with positions.

Two physical routes produce the same findings rows:

* **native** (JVM, no Python): literals, and regexes that the line-safety check in
  :mod:`trawl.functions.regex_dialect` accepts.  Each document row is split into its
  ``\\n`` lines inside the row; only lines that contain a hit are exploded, together
  with their ±context window, so the text itself is never copied per line.
* **python** (``mapInPandas`` with the ``re`` module): the exact Python regex dialect
  (multi-line matches, zero-width matches, anchors, look-around), and documents whose
  lower-casing differs between the JVM and Python.

Neither route shuffles; the only exchange in a search is the optional final sort.
"""

from __future__ import annotations

import bisect
import re
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.text import highlight, java_literal, newline_lines, number_prefix, splitlines
from trawl.model import FINDING_COLUMNS, FINDING_SCHEMA, SNIPPET_LINE_MISMATCH, Query

# Characters whose lower-case form differs between the JVM and Python.
# U+0130 lower-cases to two characters in both, which shifts the offsets the original
# tool reports for everything after it; such documents take the Python route.
LENGTH_CHANGING_LOWER = "\u0130"
# Unicode 16 letters that the JVM lower-cases and Python 3.13 does not, and their JVM
# lower-case forms.  They only matter when the query contains one of them.
JVM_ONLY_LOWER = "\u1C89\uA7CB\uA7CC\uA7DA\uA7DC" + "".join(chr(c) for c in range(0x10D50, 0x10D66))
JVM_ONLY_LOWERED = "\u1C8A\u0264\uA7CD\uA7DB\u019B" + "".join(chr(c) for c in range(0x10D70, 0x10D86))


# --------------------------------------------------------------------------- python


def _line_index(newlines: list[int], offset: int) -> int:
    """0-based line of ``offset``: the number of ``\\n`` strictly before it."""
    return bisect.bisect_left(newlines, offset)


def _snippet(slines: list[str], li: int, start: int, end: int, context: int) -> str:
    if li >= len(slines):
        return SNIPPET_LINE_MISMATCH
    lo, hi = max(0, li - context), min(len(slines), li + context + 1)
    out = []
    for i in range(lo, hi):
        line = slines[i]
        if i == li:
            b = min(end, len(line))
            a = min(start, len(line), b)
            line = f"{line[:a]}>>>{line[a:b]}<<<{line[b:]}"
        out.append(f"{i + 1:4d}: {line}")
    return "\n".join(out)


def _occurrences(text: str, query: Query, pattern: re.Pattern | None):
    """Yield ``(start, matched_text)`` over the whole text, in order."""
    if pattern is not None:
        for m in pattern.finditer(text):
            yield m.start(), m.group(0)
        return
    qlen = len(query.text)
    needle = query.text if query.case_sensitive else query.text.lower()
    hay = text if query.case_sensitive else text.lower()
    pos = hay.find(needle)
    while pos != -1:
        # positions come from the (possibly lower-cased) haystack, text from the original
        yield pos, text[pos : pos + qlen]
        pos = hay.find(needle, pos + qlen)


def locate(text: str, context: int):
    """A function from (start, matched text) in ``text`` to the finding's columns after its path."""
    newlines = [m.start() for m in re.finditer("\n", text)]
    slines = text.splitlines()

    def place(start: int, matched: str) -> tuple:
        li = _line_index(newlines, start)
        col = start - (newlines[li - 1] + 1 if li else 0)
        end = col + len(matched)
        return (li + 1, matched, col, end, _snippet(slines, li, col, end, context))

    return place


def iter_findings(path: str, text: str, query: Query, pattern=None) -> Iterator[tuple]:
    """The findings of one document one after the other, by Python semantics."""
    if not query.text or not text:
        return
    place = locate(text, query.context_lines)
    for start, matched in _occurrences(text, query, pattern):
        yield (path, *place(start, matched))


def python_findings_of(path: str, text: str, query: Query, pattern=None) -> list[tuple]:
    """All findings of one document, by Python semantics (used per row in tasks)."""
    return list(iter_findings(path, text, query, pattern))


#: What a task of the Python route holds at once: findings and characters of snippets.
ROUTE_ROWS = 5_000
ROUTE_CHARS = 4_000_000


def python_route(docs: DataFrame, query: Query) -> DataFrame:
    """Findings via ``mapInPandas``; the pattern is compiled once per task and findings are
    passed on in bounded pieces, however many a document has."""
    q = query

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = q.compiled() if q.regex else None
        rows, chars = [], 0
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                for row in iter_findings(path, text, q, pattern):
                    rows.append(row)
                    chars += len(row[2]) + len(row[5])
                    if len(rows) >= ROUTE_ROWS or chars >= ROUTE_CHARS:
                        yield pd.DataFrame.from_records(rows, columns=FINDING_COLUMNS)
                        rows, chars = [], 0
        if rows:
            yield pd.DataFrame.from_records(rows, columns=FINDING_COLUMNS)

    return docs.select("path", "text").mapInPandas(run, FINDING_SCHEMA)


PY_FINDINGS_TYPE = (
    "array<struct<line_number:bigint,match_text:string,char_start_in_line:bigint,"
    "char_end_in_line:bigint,snippet:string>>"
)


def python_findings_udf(query: Query):
    """Per-row Python findings as a column (Arrow-batched).  Fed ``NULL`` for every row
    that the JVM handles, so only the rare rows that need Python cost anything."""
    q = query

    @F.pandas_udf(PY_FINDINGS_TYPE)
    def findings_of(texts: pd.Series) -> pd.Series:
        pattern = q.compiled() if q.regex else None
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            out.append(
                [
                    {"line_number": r[1], "match_text": r[2], "char_start_in_line": r[3], "char_end_in_line": r[4], "snippet": r[5]}
                    for r in python_findings_of("", t, q, pattern)
                ]
            )
        return pd.Series(out, dtype=object)

    return findings_of


# --------------------------------------------------------------------------- native


UNROLL_LIMIT = 32  # context sizes up to this are built with unrolled, compiled expressions


def _windows(hit_idx: Column, olines: Column, slines: Column, context: int, extra=None, py: Column | None = None) -> Column:
    """Per hit line: its index, its text and the ±context window of snippet lines
    (a slice: one cheap step inside the lambda; numbering happens later, compiled).
    Index ``-1`` is the pseudo line of a document handled in Python (``py``)."""
    nsl = F.size(slines)

    def one(i):
        first = F.greatest(i - context, F.lit(0))
        count = F.greatest(F.least(nsl, i + context + 1) - first, F.lit(0))
        fields = [
            i.alias("li"),
            F.get(olines, i).alias("line"),
            first.alias("ctx_first"),
            F.slice(slines, first + 1, count).alias("ctx"),
            nsl.alias("nsl"),
        ]
        if extra is not None:
            fields.append(extra(i).alias("probe"))
        if py is not None:
            fields.append(F.when(i < 0, py).alias("py"))
        return F.struct(*fields)

    return F.transform(hit_idx, one)


def _numbered_line(h: Column, index: Column) -> Column:
    """``'%4d: ' + line`` for snippet line ``index`` of the window (null if outside)."""
    line = F.get(h["ctx"], index - h["ctx_first"])
    return F.when((index >= 0) & line.isNotNull(), F.concat(number_prefix(index + 1), line))


def with_context(hits: DataFrame, context: int) -> DataFrame:
    """Adds ``before``, ``after`` (numbered, joined) and ``sline`` to each hit line.

    Computed once per hit line and shared by its matches.  For windows up to
    ``UNROLL_LIMIT`` lines each side, every slot is a plain (compiled) expression."""
    h = F.col("h")
    li = h["li"]
    if context <= UNROLL_LIMIT:
        before = F.concat_ws("\n", *[_numbered_line(h, li - d) for d in range(context, 0, -1)])
        after = F.concat_ws("\n", *[_numbered_line(h, li + d) for d in range(1, context + 1)])
    else:
        rel = li - h["ctx_first"]
        numbered = lambda arr, first: F.array_join(
            F.transform(arr, lambda x, j: F.concat(number_prefix(first + j + 1), x)), "\n"
        )
        before = numbered(F.slice(h["ctx"], 1, rel), h["ctx_first"])
        after = numbered(F.slice(h["ctx"], rel + 2, F.greatest(F.size(h["ctx"]) - rel - 1, F.lit(0))), li + 1)
    sline = F.get(h["ctx"], li - h["ctx_first"])
    return hits.withColumn("before", before).withColumn("after", after).withColumn("sline", sline)


def snippet_column(li: Column, nsl: Column, sline: Column, before: Column, after: Column, start: Column, end: Column) -> Column:
    """The reference snippet: prepared context around the highlighted match line."""
    marked = F.concat(number_prefix(li + 1), highlight(sline, start, end))
    body = F.concat_ws("\n", F.nullif(before, F.lit("")), marked, F.nullif(after, F.lit("")))
    return F.when(li < nsl, body).otherwise(F.lit(SNIPPET_LINE_MISMATCH))


def _finish(matches: DataFrame, with_py: bool = False) -> DataFrame:
    """matches(path, h, before, after, sline, start, matched[, f]) -> findings rows;
    rows of Python-handled documents carry their finished finding in ``f``."""
    li = F.col("h.li")
    start = F.col("start")
    end = start + F.length("matched")
    cols = {
        "line_number": (li + 1).cast("long"),
        "match_text": F.col("matched"),
        "char_start_in_line": start.cast("long"),
        "char_end_in_line": end.cast("long"),
        "snippet": snippet_column(li, F.col("h.nsl"), F.col("sline"), F.col("before"), F.col("after"), start, end),
    }
    if with_py:
        f = F.col("f")
        cols = {k: F.when(f.isNotNull(), f[k]).otherwise(v) for k, v in cols.items()}
    return matches.select(F.col("path").alias("file_path"), *[v.alias(k) for k, v in cols.items()])


def _occurrence_index(n: Column) -> Column:
    """``0 .. n-1`` (empty for ``n <= 0``; ``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _lines(docs: DataFrame, lowered: bool, odd: Column | None = None, query: Query | None = None) -> DataFrame:
    """Per document, the line arrays as columns (computed once, then referenced by
    name inside lambdas: an expression inside a lambda is re-evaluated per element).
    Documents flagged ``odd`` get their findings from Python in column ``py``."""
    text = F.col("text")
    ol = newline_lines(text)
    cols = [F.col("path"), ol.alias("ol"), splitlines(text, ol).alias("sl")]
    if lowered:
        cols.append(newline_lines(F.lower(text)).alias("ll"))
    if odd is not None:
        cols += [odd.alias("odd"), python_findings_udf(query)(F.when(odd, text)).alias("py")]
    return docs.select(*cols)


OFFSET_BLOCK = 256  # pieces summed up together


def _block_sums(pieces: Column) -> Column:
    """Total length of all pieces before each block of ``OFFSET_BLOCK`` pieces."""
    blocks = F.ceil(F.size(pieces) / OFFSET_BLOCK).cast("int")
    starts = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    sums = F.transform(starts, lambda b: F.length(F.array_join(F.slice(pieces, b * OFFSET_BLOCK + 1, F.lit(OFFSET_BLOCK)), "")))
    return F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def with_block_sums(hits: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``<name>_sums`` for each array of pieces."""
    return hits.withColumns({f"{n}_sums": _block_sums(F.col(n)) for n in names})


def prefix_length(pieces: str, count: Column) -> Column:
    """Total length of the first ``count`` pieces: the sum before their block plus the pieces of
    the block, so a line costs in proportion to its matches."""
    block = F.floor(count / OFFSET_BLOCK).cast("int")
    inside = F.slice(pieces, block * OFFSET_BLOCK + 1, count - block * OFFSET_BLOCK)
    return F.element_at(f"{pieces}_sums", block + 1) + F.length(F.array_join(inside, ""))


def line_chunks(line: Column) -> Column:
    """A line as chunks of ``OFFSET_BLOCK`` characters (one pass over it)."""
    return F.regexp_extract_all(line, F.lit("(?s).{1,%d}" % OFFSET_BLOCK), F.lit(0))


def line_part(chunks: str, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` on, without scanning the line up to there."""
    block = F.floor(start / OFFSET_BLOCK).cast("int")
    count = F.floor(length / OFFSET_BLOCK).cast("int") + 2
    near = F.array_join(F.slice(chunks, block + 1, count), "")
    return near.substr(start - block * OFFSET_BLOCK + 1, length)


def _hits(lines: DataFrame, hit_idx: Column, query: Query, probe=None, with_py: bool = False) -> DataFrame:
    ol, sl = F.col("ol"), F.col("sl")
    if with_py:
        hit_idx = F.when(F.col("odd"), F.array(F.lit(-1))).otherwise(hit_idx)
    windows = _windows(hit_idx, ol, sl, query.context_lines, probe, F.col("py") if with_py else None)
    return with_context(lines.select("path", F.explode(windows).alias("h")), query.context_lines)


def _explode_matches(hits: DataFrame, n: Column, extra: list, with_py: bool) -> DataFrame:
    """One row per occurrence ``k`` of each hit line (or per Python finding)."""
    base = ["path", "h", "before", "after", "sline"] + extra
    if with_py:
        n = F.when(F.col("h.py").isNotNull(), F.size("h.py")).otherwise(n)
    out = hits.select(*base, F.explode(_occurrence_index(n)).alias("k"))
    if with_py:
        out = out.withColumn("f", F.when(F.col("h.py").isNotNull(), F.get(F.col("h.py"), F.col("k"))))
    return out


def native_literal(docs: DataFrame, query: Query, odd: Column | None = None) -> DataFrame:
    """Non-overlapping literal occurrences, found line by line on the JVM.

    Requires that the query has no ``\\n``.  Case-insensitive: documents where
    lower-casing changes lengths must be flagged by ``odd``; they are answered by the
    Python model in the same pass (no second scan).
    """
    q = query.text if query.case_sensitive else query.text.lower()
    qlen = len(query.text)
    lowered = not query.case_sensitive
    with_py = odd is not None
    lines = _lines(docs, lowered, odd, query)
    ol = F.col("ol")
    ll = F.col("ll") if lowered else ol
    hit_idx = F.filter(F.sequence(F.lit(0), F.size(ol) - 1), lambda i: F.get(ll, i).contains(q))
    probe = (lambda i: F.get(ll, i)) if lowered else None
    hits = _hits(lines, hit_idx, query, probe, with_py)
    searched = F.col("h.probe") if lowered else F.col("h.line")
    hits = with_block_sums(hits.withColumn("pieces", F.split(searched, java_literal(q), -1)), ["pieces"])
    k = F.col("k")
    if lowered:
        hits = hits.withColumn("chunks", line_chunks(F.col("h.line")))
    extra = ["chunks"] if lowered else []
    matches = _explode_matches(hits, F.size("pieces") - 1, ["pieces", "pieces_sums", *extra], with_py).select(
        "path", "h", "before", "after", "sline", *extra, *(["f"] if with_py else []),
        (prefix_length("pieces", k + 1) + k * qlen).alias("start"),
    ).withColumn("matched", line_part("chunks", F.col("start"), F.lit(qlen)) if lowered else F.lit(query.text))
    return _finish(matches, with_py)


def native_regex(
    docs: DataFrame, query: Query, java_pattern: str, odd: Column | None = None, must: str | None = None
) -> DataFrame:
    """Regex occurrences for line-safe patterns (cannot match ``\\n`` or the empty string).

    ``regexp_extract_all`` gives the matched texts and ``split`` the text between
    them; both scan left to right with the same engine, so they pair up.  Documents
    flagged ``odd`` are answered by Python in the same pass.
    """
    with_py = odd is not None
    lines = _lines(docs, False, odd, query)
    ol = F.col("ol")
    if must:
        from trawl.functions.regex_dialect import literal_test

        def line_hit(i):
            line = F.get(ol, i)
            return literal_test(line, query, must) & line.rlike(java_pattern)
    else:

        def line_hit(i):
            return F.get(ol, i).rlike(java_pattern)

    hit_idx = F.filter(F.sequence(F.lit(0), F.size(ol) - 1), line_hit)
    hits = _hits(lines, hit_idx, query, None, with_py)
    line = F.col("h.line")
    hits = hits.select(
        "path", "h", "before", "after", "sline",
        F.regexp_extract_all(line, F.lit(java_pattern), F.lit(0)).alias("found"),
        F.split(line, java_pattern, -1).alias("pieces"),
    )
    hits = with_block_sums(hits, ["pieces", "found"])
    k = F.col("k")
    found = F.col("found")
    matches = _explode_matches(hits, F.size("found"), ["found", "pieces", "pieces_sums", "found_sums"], with_py).select(
        "path", "h", "before", "after", "sline", *(["f"] if with_py else []),
        (prefix_length("pieces", k + 1) + prefix_length("found", k)).alias("start"),
        F.get(found, k).alias("matched"),
    )
    return _finish(matches, with_py)
