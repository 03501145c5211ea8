"""Literal search in texts of any length: a text is cut into chunks, each a row of its own.

A chunk carries the ``ahead`` characters that follow it, so an occurrence that crosses a seam is
found in the chunk where it starts.  What a finding needs from the rest of its text comes from
sums over the chunks before it (lines, position of the last line end), taken in two levels: within
blocks of ``BLOCK`` chunks, then over the totals of the blocks.  Where occurrences can overlap
(``aa`` in ``aaa``), each chunk tells for every number of its first characters that may already be
taken how many of the next chunk it takes, and these small maps are chained the same way.

The lines of a snippet are cut from blocks of ``LINES`` lines put together from the chunks that
hold them; only blocks with a finding are built.  The findings of a chunk stay one row until they meet the
lines they need, cut from the block, under a key with the chunk, so the findings of one long line spread.

The findings are those of :func:`trawl.plans.search.find`.  Texts with ``İ`` (its lower-case form
is two characters, which shifts all later positions) and queries with a sigma or a letter that the
engines lower-case differently are handed to ``find`` whole when case does not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.model import FINDING_COLUMNS, Query
from trawl.operators.match import LENGTH_CHANGING_LOWER, ROUTE_CHARS, UNROLL_LIMIT, snippet_column, with_context
from trawl.functions.text import splitlines
from trawl.session import checkpoint_dir

CHUNK_BYTES = 1 << 18
BLOCK = 1024  # chunks summed up together
LINES = 64  # lines of a text put together for snippets

CHUNKS = "doc long, path string, no long, text string, ahead string"
_SCANNED = (
    "doc long, path string, no long, chars long, newlines long, last_newline long, boundaries long, open boolean,"
    " exits array<int>, found array<struct<start:int,newlines:int,line_start:int,matched:string>>, text string"
)


def cut(corpus: DataFrame, chunk_bytes: int = CHUNK_BYTES, ahead: int = 0) -> DataFrame:
    """The texts of ``corpus`` as chunks of about ``chunk_bytes`` UTF-8 bytes with the ``ahead`` characters
    after them; ``\\r\\n`` and characters are never cut.  Null and empty texts give none.

    The bytes are sliced next to the scan, so no text leaves its row as a whole."""
    last = F.floor((F.octet_length("text") - 1) / chunk_bytes)
    pos = F.col("no") * chunk_bytes
    lead = F.when(F.col("no") > 0, 1).otherwise(0)  # the byte before, to see a \r
    piece = F.col("text").cast("binary").substr((pos + 1 - lead).cast("int"), (lead + chunk_bytes + 4 + 4 * ahead).cast("int"))
    named = corpus.select(F.coalesce("path", F.lit("")).alias("path"), "text").where(F.length("text") > 0)
    numbered = named.withColumn("doc", F.monotonically_increasing_id())
    pieces = numbered.select("doc", "path", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("no"))

    def one(no: int, data: bytes) -> tuple[str, str]:
        lead = 1 if no else 0

        def seam(i: int) -> int:
            while i < len(data) and data[i] & 0xC0 == 0x80:
                i += 1
            return i + 1 if i and data[i - 1 : i + 1] == b"\r\n" else i

        start = seam(lead) if lead else 0
        end = max(start, seam(lead + chunk_bytes))
        after = data[end : end + 4 * ahead].decode("utf-8", "ignore")
        return data[start:end].decode("utf-8", "replace"), after[:ahead]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [one(*row) for row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            columns = [*batch.columns[:3], *(pa.array([t[k] for t in texts], pa.string()) for k in (0, 1))]
            out = pa.RecordBatch.from_arrays(columns, names=_names(CHUNKS))
            yield out.filter(pc.not_equal(out.column(3), ""))

    return pieces.select("doc", "path", "no", piece.alias("data")).mapInArrow(run, CHUNKS)


def _names(schema: str) -> list[str]:
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", schema))
    return [column.split()[0] for column in flat.split(",")]


def _overlaps(needle: str) -> bool:
    return any(needle.startswith(needle[i:]) for i in range(1, len(needle)))


def _free(starts: list[int], size: int, taken: int) -> list[bool]:
    """Which occurrences count when the first ``taken`` characters belong to an earlier one."""
    out = [False] * len(starts)
    i = bisect_left(starts, taken)
    while i < len(starts):
        out[i] = True
        i = bisect_left(starts, starts[i] + size, i + 1)
    return out


def _exits(starts: list[int], size: int, chars: int) -> list[int]:
    """For every number of taken first characters below ``size``: how many of the next chunk are taken."""
    known: dict[int, int] = {}
    out = []
    for taken in range(size):
        i, way, free = bisect_left(starts, taken), [], taken
        while i < len(starts) and i not in known:
            way.append(i)
            free = starts[i] + size
            i = bisect_left(starts, free, i + 1)
        left = known[i] if i < len(starts) else max(0, free - chars)
        known.update(dict.fromkeys(way, left))
        out.append(left)
    return out


def _scan(query: Query):
    """One pass over the chunks: counts of each chunk and the occurrences that start in it."""
    needle = query.text if query.case_sensitive else query.text.lower()
    size, overlapping = len(needle), _overlaps(needle)

    def one(text, ahead):
        both = text + ahead[: size - 1]
        hay = both if query.case_sensitive else both.lower()
        ends = [m.start() for m in re.finditer("\n", text)]
        starts, at = [], hay.find(needle)
        while at != -1:
            starts.append(at)
            at = hay.find(needle, at + (1 if overlapping else size))
        found = []
        for s in starts:
            before = bisect_left(ends, s)
            found.append((s, before, ends[before - 1] + 1 if before else -1, both[s : s + size]))
        lines = text.splitlines(keepends=True)
        is_open = lines[-1].splitlines()[0] == lines[-1]
        exits = _exits(starts, size, len(text)) if overlapping else None
        last = ends[-1] + 1 if ends else None
        return (len(text), len(ends), last, len(lines) - is_open, is_open, exits), found

    def frame(batch, rows, found, offsets):
        counts = zip(*rows)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
        fields = zip(("start", "newlines", "line_start", "matched"), [pa.int32()] * 3 + [pa.string()], zip(*found) if found else [()] * 4)
        flat = {name: pa.array(values, kind) for name, kind, values in fields}
        held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(flat.values()), names=list(flat)))
        columns = [*batch.columns[:3], *(pa.array(c, k) for c, k in zip(counts, kinds)), held, batch.column(3)]
        return pa.RecordBatch.from_arrays(columns, names=_names(_SCANNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, rows, found, offsets, chars = 0, [], [], [0], 0
            for text, ahead in zip(batch.column(3), batch.column(4)):
                counts, here = one(text.as_py(), ahead.as_py())
                rows.append(counts)
                found += here
                offsets.append(len(found))
                chars += counts[0] + 64 * len(here)
                if chars >= ROUTE_CHARS:
                    yield frame(batch.slice(first, len(rows)), rows, found, offsets)
                    first, rows, found, offsets, chars = first + len(rows), [], [], [0], 0
            if rows:
                yield frame(batch.slice(first, len(rows)), rows, found, offsets)

    return run


def _counted(scanned: DataFrame) -> DataFrame:
    """Adds what lies before each chunk of a text, ``newlines_before``, ``lines_before``, ``chars_before`` and
    ``line_at`` (the start of the line that the chunk begins in), and ``nsl``, the lines of its text: the sums of
    all in one window over the chunks of a block and one over the totals of the blocks."""
    sums = {"newlines_before": "newlines", "lines_before": "boundaries", "chars_before": "chars"}
    inner = Window.partitionBy("doc", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_line = F.col("chars_before") + F.col("last_newline")

    def within(rows: DataFrame) -> DataFrame:
        return rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(n) for n, c in sums.items()])

    totals = within(scanned.select("doc", "block", "no", "open", "last_newline", *sums.values())).groupBy("doc", "block")
    totals = totals.agg(
        *[F.sum(c).alias(c) for c in sums.values()], F.max(last_line).alias("last_line"), F.max_by(F.col("open").cast("int"), "no").alias("open")
    )
    text = Window.partitionBy("doc")
    nsl = (F.sum("boundaries").over(text) + F.max_by("open", "block").over(text)).cast("int")
    totals = totals.select("doc", "block", "last_line", nsl.alias("nsl"), *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_{n}") for n, c in sums.items()])
    earlier = F.max(F.col("_chars_before") + F.col("last_line")).over(outer)
    totals = totals.withColumn("_line_at", earlier).drop("last_line")
    rows = within(scanned).withColumn("line_at", F.max(last_line).over(inner)).join(totals, ["doc", "block"])
    line_at = F.greatest(F.col("_chars_before") + F.col("line_at"), F.col("_line_at"), F.lit(0))
    rows = rows.withColumn("line_at", line_at)
    for name in sums:
        rows = rows.withColumn(name, F.col(name) + F.col(f"_{name}"))
    return rows.drop("_line_at", *[f"_{name}" for name in sums])


def _chained(scanned: DataFrame, size: int) -> DataFrame:
    """Keeps the occurrences that do not overlap an earlier one of the text."""
    whole = "doc long, block long, exits array<int>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = list(range(size))
        for exits in pdf.sort_values("no")["exits"]:
            state = [int(exits[s]) for s in state]
        return pd.DataFrame([(pdf["doc"].iloc[0], pdf["block"].iloc[0], state)], columns=_names(whole))

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, taken = [], 0
        for doc, block, exits in pdf.sort_values("block")[["doc", "block", "exits"]].itertuples(index=False):
            rows.append((doc, block, taken))
            taken = int(exits[taken])
        return pd.DataFrame(rows, columns=["doc", "block", "taken"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, taken = [], int(pdf["taken"].iloc[0])
        for doc, no, exits in pdf.sort_values("no")[["doc", "no", "exits"]].itertuples(index=False):
            rows.append((doc, no, taken))
            taken = int(exits[taken])
        return pd.DataFrame(rows, columns=["doc", "no", "taken"])

    @F.pandas_udf("array<boolean>")
    def free(starts: pd.Series, taken: pd.Series) -> pd.Series:
        return pd.Series([_free(list(s), size, int(t)) for s, t in zip(starts, taken)], dtype=object)

    maps = scanned.select("doc", "block", "no", "exits")
    blocks = maps.groupBy("doc", "block").applyInPandas(fold, whole)
    entries = blocks.groupBy("doc").applyInPandas(enter, "doc long, block long, taken int")
    taken = maps.join(entries, ["doc", "block"]).groupBy("doc", "block").applyInPandas(walk, "doc long, no long, taken int")
    rows = scanned.join(taken, ["doc", "no"]).withColumn("_free", free(F.col("found.start"), F.col("taken")))
    kept = F.filter("found", lambda f, i: F.get("_free", i))
    return rows.withColumn("found", kept).drop("_free", "taken")


def _line_blocks(counted: DataFrame, wanted: DataFrame, context: int) -> DataFrame:
    """``doc, lines_of, lines`` for the wanted blocks of lines, with ``context`` lines on either side."""
    first = F.col("lines_before")
    last = first + F.col("boundaries") - F.when(F.col("open"), 0).otherwise(1)
    of = F.sequence(F.floor(F.greatest(first - context, F.lit(0)) / LINES), F.floor((last + context) / LINES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, chars = [], 0
            for doc, no, before, blocks, text in zip(*(pdf[c] for c in ("doc", "no", "lines_before", "blocks", "text"))):
                lines = text.splitlines(keepends=True)
                for b in blocks:
                    lo, hi = (max(0, b * LINES + side - before) for side in (-context, LINES + context))
                    rows.append((doc, b, no, "".join(lines[lo:hi])))
                    chars += len(rows[-1][3])
                    if chars >= ROUTE_CHARS:
                        yield pd.DataFrame.from_records(rows, columns=["doc", "lines_of", "no", "piece"])
                        rows, chars = [], 0
            if rows:
                yield pd.DataFrame.from_records(rows, columns=["doc", "lines_of", "no", "piece"])

    spans = counted.select("doc", "no", "lines_before", of.alias("blocks"), "text")
    pieces = spans.mapInPandas(run, "doc long, lines_of long, no long, piece string").where("piece <> ''")
    pieces = pieces.join(wanted.select("doc", "lines_of").distinct(), ["doc", "lines_of"], "left_semi")
    in_order = F.sort_array(F.collect_list(F.struct("no", "piece")))
    text = F.array_join(F.transform(in_order, lambda p: p["piece"]), "")
    return pieces.groupBy("doc", "lines_of").agg(text.alias("text")).select("doc", "lines_of", splitlines(F.col("text")).alias("lines"))


def search_chunked(corpus: DataFrame, query: Query, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Findings of a literal ``query``, equal to those of ``find``, with chunks of ``chunk_bytes`` as rows."""
    from trawl.plans.search import empty_findings, find, route, spread

    if query.regex:
        raise ValueError("chunks are searched for literals only")
    if query.is_empty:
        return empty_findings(corpus)
    folded = query.text.lower()
    one_line = query.text.replace("\n", "").replace("\r", "")
    if not query.case_sensitive and (
        any(c in folded for c in "σς") or (one_line and route(Query(one_line)) == "python")
    ):
        return find(corpus, query)
    checkpoint_dir(corpus.sparkSession)
    text, context = F.col("text"), query.context_lines
    if query.case_sensitive:
        whole = None
    else:
        odd = F.coalesce(text.contains(LENGTH_CHANGING_LOWER), F.lit(False))
        whole, corpus = find(corpus.where(odd), query), corpus.where(~odd)
    chunks = cut(corpus, chunk_bytes, len(query.text) - 1)
    scanned = spread(chunks).mapInArrow(_scan(query), _SCANNED).withColumn("block", F.floor(F.col("no") / BLOCK))
    scanned = scanned.checkpoint(eager=True)
    if _overlaps(query.text if query.case_sensitive else folded):
        scanned = _chained(scanned, len(query.text))
    counted = _counted(scanned.drop("exits")).checkpoint(eager=True)

    def placed(f):
        start = f["start"] - F.when(f["line_start"] >= 0, f["line_start"]).otherwise(F.col("line_at") - F.col("chars_before"))
        return F.struct((F.col("newlines_before") + f["newlines"]).cast("int").alias("li"), start.alias("start"), f["matched"].alias("matched"))

    def lines_of(f):
        return F.floor(f["li"] / LINES)

    hits = counted.where(F.size("found") > 0).select("doc", "no", "path", "nsl", F.transform("found", placed).alias("found"))
    hits = hits.select("*", F.explode(F.array_distinct(F.transform("found", lines_of))).alias("lines_of"))
    hits = hits.withColumn("found", F.filter("found", lambda f: lines_of(f) == F.col("lines_of")))
    low = F.greatest(F.col("found")[0]["li"] - context, F.lit(0))
    wanted = hits.select("doc", "no", "lines_of", low.alias("low"), (F.element_at("found", -1)["li"] + context).alias("high"))
    block_first = F.greatest(F.col("lines_of").cast("int") * LINES - context, F.lit(0))
    lines = wanted.join(_line_blocks(counted, wanted, context), ["doc", "lines_of"]).select(
        "doc", "no", "lines_of", "low", F.slice("lines", F.col("low") - block_first + 1, F.col("high") - F.col("low") + 1).alias("lines")
    )
    hits = hits.join(lines, ["doc", "no", "lines_of"], "left").select("path", "nsl", "low", "lines", F.inline("found"))
    first, window = F.col("low"), F.col("lines")
    if context > UNROLL_LIMIT:  # takes all lines that it is given
        first = F.greatest(F.col("li") - context, F.lit(0))
        window = F.slice("lines", first - F.col("low") + 1, F.lit(2 * context + 1) - F.greatest(context - F.col("li"), F.lit(0)))
    h = F.struct("li", first.alias("ctx_first"), window.alias("ctx"), "nsl")
    hits = with_context(hits.select("path", "start", "matched", h.alias("h")), context)
    end = F.col("start") + F.length("matched")
    snippet = snippet_column(F.col("h.li"), F.col("h.nsl"), F.col("sline"), F.col("before"), F.col("after"), F.col("start"), end)
    out = hits.select(
        F.col("path").alias("file_path"), (F.col("h.li") + 1).cast("long").alias("line_number"), F.col("matched").alias("match_text"),
        F.col("start").cast("long").alias("char_start_in_line"), end.cast("long").alias("char_end_in_line"), snippet.alias("snippet"),
    ).select(*FINDING_COLUMNS)
    return out if whole is None else out.unionByName(whole.select(*FINDING_COLUMNS))
