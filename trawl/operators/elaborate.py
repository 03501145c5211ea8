"""Elaboration: findings joined back to their source, wider context, prompt, model call.

The original tool elaborates one finding per call.  Here the whole findings table is
elaborated in one job:

1. **context lines** - a source file with findings gives one slice of lines for every
   block of lines that some finding is in, and a finding meets the slice of its block.
   The join key includes the block, so a file with many findings does not become one
   hot key; the source side is reduced to files that have findings first (broadcast of
   the file list only when its measured size is small, a shuffle join otherwise).
2. **context block and prompt** - plain column expressions.
3. **model call** - ``mapInPandas`` calling a user-supplied ``model_fn(prompts) ->
   replies`` per Arrow batch.  Failures become ``Error: ...`` texts with
   ``status='error'``; a task never fails because of a reply.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.text import splitlines

REQUIRED_KEYS = ["file_path", "line_number", "snippet", "match_text"]

# Texts of the original tool's prompt and context block.
SNIPPET_HEAD = "The following snippet was found:\n------------------SNIPPET------------------\n"
SNIPPET_TAIL = "\n----------------END SNIPPET------------------\n\n"
CONTEXT_HEAD = (
    "Here is a broader context from the file (matched line marked with '>>'):\n"
    "----------------FILE CONTEXT-----------------\n"
)
CONTEXT_TAIL = "\n--------------END FILE CONTEXT---------------"
PROMPT_HEAD = "You are an expert AI programming assistant. A code search found a match.\nFile: "
PROMPT_BODY = (
    "\n\nPlease elaborate on this code. Your analysis should be concise (2-4 sentences ideally, max 150 words) "
    "and focus on:\n"
    "1. What is this code snippet primarily doing or responsible for?\n"
    "2. Based on the surrounding code (if available) and the snippet itself, what are potential implications, "
    "common use cases, or important considerations related to this code?\n"
    "3. If applicable, suggest any potential improvements or best practices ONLY IF they are obvious and highly "
    "relevant. Avoid speculation.\n"
    "Present your analysis clearly. Do not repeat the code itself in your answer unless quoting a very small, "
    "specific part for clarification."
)
ERR_NO_CHOICES = "Error: No content returned from API for elaboration"
ERR_EMPTY = "Error: Elaboration from API was empty or unparsable"

BROADCAST_FILE_LIST_BYTES = 64 * 1024 * 1024


# ------------------------------------------------------------------------- validation


def validate(findings: DataFrame) -> DataFrame:
    """``valid`` and ``error`` columns; a finding missing a required key is invalid."""
    missing = F.lit(False)
    for k in REQUIRED_KEYS:
        missing = missing | (F.col(k).isNull() if k in findings.columns else F.lit(True))
    msg = F.format_string(
        "Error: Finding at index %d has an invalid structure. Missing one of ['file_path', 'line_number', 'snippet', 'match_text'].",
        F.col("finding_id"),
    )
    return findings.withColumn("valid", ~missing).withColumn("error", F.when(missing, msg))


# ------------------------------------------------------------------------- context


def _with_source_files(findings: DataFrame, corpus: DataFrame) -> tuple[DataFrame, bool]:
    """Corpus rows of the files that have findings (path, text), and whether the file
    list is small enough to broadcast (measured: count and longest path)."""
    paths = findings.select(F.col("file_path").alias("path")).distinct()
    stats = paths.agg(F.count("*").alias("n"), F.max(F.length("path")).alias("longest")).first()
    small = (stats["n"] or 0) * ((stats["longest"] or 0) + 32) <= BROADCAST_FILE_LIST_BYTES
    columns = [c for c in ("path", "text", "mtime") if c in corpus.columns]
    return corpus.select(*columns).join(F.broadcast(paths) if small else paths, "path", "left_semi"), small


def resolve_report_paths(findings: DataFrame, report_dir: str, corpus: DataFrame) -> DataFrame:
    """A relative ``file_path`` of a report is read as ``<report_dir>/<file_path>``
    when the corpus has that file; otherwise it stays as it is.

    Only the distinct candidate paths meet the corpus (a semi join); the resolved set is
    broadcast back only when its measured size is small, else joined by shuffle."""
    base = report_dir.rstrip("/")
    fp = F.col("file_path")
    cand = F.when(~fp.startswith("/"), F.concat(F.lit(base + "/"), fp))
    with_cand = findings.withColumn("_cand", cand)
    wanted = with_cand.where(F.col("_cand").isNotNull()).select(F.col("_cand").alias("path")).distinct()
    found = corpus.select("path").join(wanted, "path", "left_semi").select(
        F.col("path").alias("_cand"), F.lit(True).alias("_exists")
    )
    stats = found.agg(F.count("*").alias("n"), F.max(F.length("_cand")).alias("longest")).first()
    small = (stats["n"] or 0) * ((stats["longest"] or 0) + 32) <= BROADCAST_FILE_LIST_BYTES
    joined = with_cand.join(F.broadcast(found) if small else found, "_cand", "left")
    return joined.withColumn("file_path", F.when(F.col("_exists"), F.col("_cand")).otherwise(fp)).drop("_cand", "_exists")


#: Lines of a source file that are cut out together (more for wide windows).
BLOCK_LINES = 64


def one_per_path(corpus: DataFrame) -> DataFrame:
    """``corpus`` with one row per path: of several the one with the latest ``mtime``, ties broken by
    a hash of the text; rows without a text give way.  Nothing is shuffled but paths if none is repeated."""
    if corpus.groupBy("path").count().where("count > 1").isEmpty():
        return corpus
    mtime = F.coalesce(F.col("mtime"), F.lit(0.0)) if "mtime" in corpus.columns else F.lit(0.0)
    newest = F.struct(F.col("text").isNotNull(), mtime, F.xxhash64("text"))
    row = F.struct(*[F.col(c) for c in corpus.columns])
    return corpus.groupBy(F.col("path").alias("_path")).agg(F.max_by(row, newest).alias("_row")).select("_row.*")


def context_lines(findings: DataFrame, corpus: DataFrame, window: int = 10) -> DataFrame:
    """E1 + E3: per finding, ``has_content`` and the numbered window of source lines.

    ``findings`` needs ``finding_id, file_path, line_number``.  A file's lines are thought of as blocks;
    each file is split into lines once and gives one row for every block some finding is in, with the
    block's lines and a window more on either side.  So findings near each other share one slice, a
    finding meets one row, and a file with very many findings is spread over its blocks.  A path that
    the corpus holds several times counts once (:func:`one_per_path`).  Missing sources give
    ``has_content = false`` and an empty window (the caller falls back to the snippet).
    """
    size = max(BLOCK_LINES, 2 * window)
    li = F.col("line_number").cast("int") - 1
    block = F.when(li.isNotNull(), F.floor(F.greatest(li, F.lit(0)) / size).cast("int"))
    src, _small = _with_source_files(findings, corpus)
    asked = findings.select(F.col("file_path").alias("path"), block.alias("block")).where("block is not null").distinct()
    src = one_per_path(src).where("text is not null").join(asked.groupBy("path").agg(F.collect_list("block").alias("blocks")), "path")
    start = lambda b: F.greatest(b * size - window, F.lit(0))

    def cut(lines: Column) -> Column:
        def one(b):
            stop = (b + 1) * size + window
            return F.struct(b.alias("_block"), start(b).alias("_first"), F.slice(lines, start(b) + 1, stop - start(b)).alias("_lines"))

        return F.transform("blocks", one)

    # the lines are bound by a lambda of their own, or they would be split again for every block
    cuts = F.transform(F.array(splitlines(F.col("text"))), cut)[0]
    parts = src.select(F.col("path").alias("_path"), (F.length("text") > 0).alias("_has"), F.inline(cuts))
    got = findings.join(parts, (F.col("file_path") == F.col("_path")) & (block == F.col("_block")), "left")
    first = F.greatest(li - window, F.lit(0))
    near = F.slice("_lines", F.greatest(first - F.col("_first"), F.lit(0)) + 1, F.greatest(li + window, F.lit(0)) - first + 1)

    def marked(line: Column, i: Column) -> Column:
        at = first + i
        number = F.when(at < 9999, F.lpad((at + 1).cast("string"), 4, " ")).otherwise((at + 1).cast("string"))
        return F.concat(F.when(at == li, F.lit(">> ")).otherwise(F.lit("  ")), number, F.lit(": "), line)

    return got.select(
        *[F.col(c) for c in findings.columns],
        F.coalesce("_has", F.lit(False)).alias("has_content"),
        F.coalesce(F.array_join(F.transform(near, marked), "\n"), F.lit("")).alias("file_context"),
    )


def context_block(snippet: Column, has_content: Column, file_context: Column) -> Column:
    """Snippet and file window between rulers, or the snippet alone."""
    block = F.concat(F.lit(SNIPPET_HEAD), snippet, F.lit(SNIPPET_TAIL), F.lit(CONTEXT_HEAD), file_context, F.lit(CONTEXT_TAIL))
    return F.when(has_content, block).otherwise(snippet)


def prompt(file_path: Column, line_number: Column, context: Column) -> Column:
    """E5."""
    return F.concat(
        F.lit(PROMPT_HEAD), file_path, F.lit("\nLine: "), line_number.cast("string"),
        F.lit("\n\nContext/Code:\n"), context, F.lit(PROMPT_BODY),
    )


def prompts(findings: DataFrame, corpus: DataFrame, window: int = 10) -> DataFrame:
    """Findings with ``context`` and ``prompt`` columns (everything before the model)."""
    ctx = context_lines(findings, corpus, window)
    return ctx.withColumn("context", context_block(F.col("snippet"), F.col("has_content"), F.col("file_context"))).withColumn(
        "prompt", prompt(F.col("file_path"), F.col("line_number"), F.col("context"))
    )


# ------------------------------------------------------------------------- model call

ModelFn = Callable[[Sequence[str]], Sequence]


def _classify(reply, exc, file_path, line_number) -> tuple[str, str]:
    """(status, text) of one reply."""
    if exc is not None:
        return "error", f"Error: API error during elaboration for {file_path}:{line_number} (model): {type(exc).__name__} - {exc}"
    if reply is None:
        return "error", ERR_NO_CHOICES
    if not isinstance(reply, str) or not reply.strip():
        return "error", ERR_EMPTY
    return "ok", reply


#: Prompts per call: what a raising call makes ask again.
MODEL_BATCH = 16


def _replies(model_fn: ModelFn, ps: list[str]) -> list:
    """Exactly one reply (or exception) per prompt."""
    try:
        replies = list(model_fn(ps))
    except Exception as exc:  # noqa: BLE001 - isolate the failing prompt
        if len(ps) == 1:
            return [exc]
        return [r for p in ps for r in _replies(model_fn, [p])]
    if len(replies) > len(ps):
        return [ValueError(f"{len(replies)} replies to {len(ps)} prompts")] * len(ps)
    return replies + [None] * (len(ps) - len(replies))


def call_model(df: DataFrame, model_fn: ModelFn, concurrency: int | None = None) -> DataFrame:
    """``elaboration`` and ``status`` for every row's ``prompt``.

    ``model_fn`` gets at most ``MODEL_BATCH`` prompts and returns one reply per prompt:
    a string, ``None`` (no answer), or an ``Exception`` instance for a failed call.
    If it raises, the prompts of that small batch are asked one by one so that a single
    bad prompt only marks itself.  Too few replies leave the rest without an answer; too
    many are an error of the whole batch, because it is unknown which belong.  ``concurrency`` bounds parallel calls.
    """
    df = df.drop("elaboration", "status")  # a new answer replaces any earlier one (e.g. from a report)
    keep = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField("elaboration", T.StringType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for lo in range(0, len(pdf), MODEL_BATCH):
                ps = pdf["prompt"].iloc[lo : lo + MODEL_BATCH].tolist()
                replies += _replies(model_fn, ps)
            errors = [r if isinstance(r, BaseException) else None for r in replies]
            out = [
                _classify(None if e is not None else r, e, fp, ln)
                for r, e, fp, ln in zip(replies, errors, pdf["file_path"], pdf["line_number"])
            ]
            pdf = pdf.copy()
            pdf["status"] = [s for s, _ in out]
            pdf["elaboration"] = [t for _, t in out]
            yield pdf[keep + ["elaboration", "status"]]

    src = df.repartition(concurrency) if concurrency else df
    return src.mapInPandas(run, schema)


def elaborate(findings: DataFrame, corpus: DataFrame, model_fn: ModelFn, window: int = 10, concurrency: int | None = None) -> DataFrame:
    """Bulk elaboration of a findings table with ``finding_id``."""
    checked = validate(findings)
    good = prompts(checked.where("valid"), corpus, window)
    done = call_model(good, model_fn, concurrency).select("finding_id", "elaboration", "status")
    bad = checked.where(~F.col("valid")).select("finding_id", F.col("error").alias("elaboration"), F.lit("invalid").alias("status"))
    return done.unionByName(bad)


# ------------------------------------------------------------------------- stub model


def stub_reply(p: str) -> str:
    """Deterministic stand-in for a model (tests and registered queries; no network)."""
    return f"Elaboration {hashlib.sha256(p.encode('utf-8')).hexdigest()[:16]} ({len(p)} chars)"


def stub_model(prompts_: Sequence[str]) -> list:
    return [stub_reply(p) for p in prompts_]


def flaky_stub_model(prompts_: Sequence[str]) -> list:
    """Like :func:`stub_model`, but by the first hex digit of the prompt's sha256:
    ``0`` no answer, ``1`` a blank answer, ``2`` a failed call."""
    out = []
    for p in prompts_:
        h = hashlib.sha256(p.encode("utf-8")).hexdigest()
        if h[0] == "0":
            out.append(None)
        elif h[0] == "1":
            out.append("   ")
        elif h[0] == "2":
            out.append(RuntimeError("stub failure"))
        else:
            out.append(stub_reply(p))
    return out
