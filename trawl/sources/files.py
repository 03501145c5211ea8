"""Files as a corpus: distributed directory listing, path rules, binary probe, read.

Listing is level by level: a DataFrame of directories is listed in parallel
(``mapInPandas`` + ``os.scandir``), excluded and hidden directories are dropped
*before* they are listed (pruning, like a walk that skips them), and the surviving
sub-directories form the next level.  Each level is written once to the shared
checkpoint folder, so a lost executor re-lists one level, not the whole tree.
Symbolic links to directories are followed; a link back to one of its own ancestors
(a cycle) is not descended again.

Then: path rules (F1-F6, no I/O) -> first 1 KB of each surviving file (binary probe,
F7-F9) -> full bytes of the text files -> decoded text.  Spark's ``binaryFile`` source
is not used: it skips names starting with ``_`` or ``.`` and empty files.
"""

from __future__ import annotations

import os
import re
import stat
import sys
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.paths import relative_path
from trawl.operators.filters import (
    PathRules,
    binary_by_content,
    binary_by_extension,
    dir_excluded,
    excluded_file,
    hidden,
)
from trawl.session import checkpoint_dir
from trawl.sources.content import decode_text

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("chain", T.ArrayType(T.StringType())),
        T.StructField("cycle", T.BooleanType()),
    ]
)
LEVEL_SCHEMA = "path string, root string, chain array<string>"


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per entry of every listed directory."""
    for pdf in batches:
        rows = []
        for d, root, chain in zip(pdf["path"], pdf["root"], pdf["chain"]):
            chain = list(chain) if chain is not None else []
            try:
                with os.scandir(d) as it:
                    entries = list(it)
            except OSError:
                continue
            for e in entries:
                p = os.path.join(d, e.name)
                try:
                    is_dir = e.is_dir()  # follows links
                except OSError:
                    is_dir = False
                if is_dir:
                    real = os.path.realpath(p)
                    rows.append((p, root, True, None, None, chain + [real], real in chain))
                    continue
                try:
                    st = os.stat(p)
                    mtime = float(st.st_mtime) if stat.S_ISREG(st.st_mode) else None
                    size = int(st.st_size)
                except OSError:  # broken link and the like: no timestamp, skipped later
                    mtime, size = None, None
                rows.append((p, root, False, mtime, size, None, False))
        yield pd.DataFrame.from_records(rows, columns=[f.name for f in ENTRY_SCHEMA.fields])


def _read_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        heads = []
        for p in pdf["path"]:
            try:
                with open(p, "rb") as fh:
                    heads.append(fh.read(1024))
            except OSError:
                heads.append(None)  # unreadable: assumed text (F9)
        out = pdf.copy()
        out["head"] = heads
        yield out


#: Bytes of files that a reading task holds at once (one larger file is held alone).
READ_BYTES = 16 * 1024 * 1024


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "mtime", "content", "error"]
    for pdf in batches:
        rows, held = [], 0
        for p, mtime in zip(pdf["path"], pdf["mtime"]):
            try:
                with open(p, "rb") as fh:
                    data, error = fh.read(), None
            except OSError as exc:  # M13: this file is reported, the others go on
                data, error = None, f"{type(exc).__name__}: {exc.strerror}"
            rows.append((p, mtime, data, error))
            held += len(data or b"")
            if held >= READ_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def resolve_roots(paths: list[str], workspace: str | None = None) -> list[str]:
    """absolute paths as given; relative ones against ``workspace`` if that
    candidate exists, else against the current directory."""
    out = []
    for p in paths:
        if os.path.isabs(p):
            out.append(os.path.normpath(p))
        elif workspace and os.path.exists(os.path.normpath(os.path.join(workspace, p))):
            out.append(os.path.normpath(os.path.join(workspace, p)))
        else:
            out.append(os.path.abspath(p))
    return out


_DRIVE = re.compile(r"^[A-Za-z]:[\\/]?$")


def guard_roots(original: list[str], resolved: list[str]) -> None:
    """refuse a filesystem root; say so differently when a relative input
    resolved to it."""
    for orig, rp in zip(original, resolved):
        if rp == "/" or _DRIVE.match(rp):
            if orig != "/" and not _DRIVE.match(orig):
                raise ValueError(
                    f"Path Resolution Error: You provided '{orig}', which resolved to the root directory ('{rp}'). "
                    "Pass the full absolute path of the workspace instead."
                )
            raise ValueError(
                f"Security/Performance Error: Attempted to scan the entire filesystem root ('{rp}'). "
                "Please specify a more targeted folder."
            )


def _spread(df: DataFrame, n: int) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(n, cores * 4)))


def list_files(spark: SparkSession, roots: list[str], rules: PathRules = PathRules()) -> DataFrame:
    """``(path, root, mtime, size)`` of every file under ``roots`` that passes
    the path rules (no file is opened yet).  Missing roots are skipped with a warning;
    a root that is a file is checked against its own folder (S2)."""
    checkpoint_dir(spark)
    dir_roots, file_rows = [], []
    for r in roots:
        a = os.path.abspath(os.path.expanduser(r))
        if os.path.isdir(a):
            dir_roots.append(a)
        elif os.path.isfile(a):
            try:
                file_rows.append((a, os.path.dirname(a), float(os.path.getmtime(a)), int(os.path.getsize(a))))
            except OSError:
                continue
        else:
            print(f"Warning: Path '{r}' does not exist. Skipping.", file=sys.stderr)
    parts = []
    if file_rows:
        parts.append(spark.createDataFrame(file_rows, "path string, root string, mtime double, size long"))
    level = spark.createDataFrame([(r, r, [os.path.realpath(r)]) for r in dir_roots], LEVEL_SCHEMA)
    n = len(dir_roots)
    while n:
        entries = _spread(level, n).mapInPandas(_list_level, ENTRY_SCHEMA).checkpoint(eager=True)
        parts.append(entries.where(~F.col("is_dir")).select("path", "root", "mtime", "size"))
        rel = relative_path(F.col("path"), F.col("root"))
        prune = dir_excluded(rel, rules)
        if rules.exclude_dot_items:
            prune = prune | hidden(rel)
        level = entries.where(F.col("is_dir") & ~F.col("cycle") & ~prune).select("path", "root", "chain")
        n = level.count()
    if not parts:
        return spark.createDataFrame([], "path string, root string, mtime double, size long")
    files = parts[0]
    for p in parts[1:]:
        files = files.unionByName(p)
    rel = relative_path(F.col("path"), F.col("root"))
    keep = ~excluded_file(rel, rules) & ~binary_by_extension(F.col("path"), rules)
    if rules.exclude_dot_items:
        keep = keep & ~hidden(rel)
    return files.where(keep).where(F.col("mtime").isNotNull())


def drop_binary_files(listing: DataFrame) -> DataFrame:
    """F7-F9 on the first 1 KB of every listed file."""
    heads = listing.mapInPandas(_read_head, T.StructType(listing.schema.fields + [T.StructField("head", T.BinaryType())]))
    return heads.where(~binary_by_content(F.col("head"))).drop("head")


def scan(spark: SparkSession, roots: list[str], rules: PathRules = PathRules(), dedupe: bool = True) -> DataFrame:
    """S1-S4 + F1-F9: the text files to search, ``(path, root, mtime, size)``.

    ``dedupe`` keeps one row per path (the CLI's set), and the caller sorts if needed."""
    files = list_files(spark, roots, rules)
    return drop_binary_files(files.dropDuplicates(["path"]) if dedupe else files)


def dedupe_sorted(listing: DataFrame) -> DataFrame:
    """One row per path, the one found from the shortest root (ties: the first), in order of the path, with
    its ``position`` from 0.  Positions come from sorted ranges of paths: no task sees all of them."""
    from trawl.operators.report import with_positions

    first = F.struct(F.length("root"), F.col("root"))
    row = F.struct(*[F.col(c) for c in listing.columns if c != "path"])
    files = listing.groupBy("path").agg(F.min_by(row, first).alias("_row")).select("path", "_row.*")
    return with_positions(files, ["path"], "position")


def read_corpus(files: DataFrame) -> DataFrame:
    """``(path, text, mtime)``; files that cannot be read drop out."""
    with_bytes = read_files(files).where(F.col("content").isNotNull())
    return with_bytes.select("path", decode_text(F.col("content")).alias("text"), "mtime").where(F.col("text").isNotNull())


def read_files(files: DataFrame) -> DataFrame:
    """``(path, mtime, content, error)``: the bytes of every file, or why it cannot be read."""
    return files.select("path", "mtime").mapInPandas(_read_all, "path string, mtime double, content binary, error string")


def read_errors(files: DataFrame) -> DataFrame:
    """``(path, error)`` of the files that cannot be read."""
    return read_files(files).where(F.col("error").isNotNull()).select("path", "error")


def files_corpus(spark: SparkSession, roots: list[str], rules: PathRules = PathRules()) -> DataFrame:
    """Everything a search over files needs: listing, filters, read, decode."""
    return read_corpus(scan(spark, roots, rules))


def _stamp(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for p in pdf["path"]:
            try:
                out.append(float(os.path.getmtime(p)) if os.path.exists(p) else 0.0)
            except OSError:
                out.append(0.0)
        yield pd.DataFrame({"path": pdf["path"], "mtime": out})


def stamp_paths(paths: DataFrame) -> DataFrame:
    """S6 for a column of bare paths: ``(path, mtime)``, ``0.0`` when it cannot be read."""
    return paths.select("path").mapInPandas(_stamp, "path string, mtime double")


def with_timestamps(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S6 for a few paths given on the driver (the command-line case)."""
    return stamp_paths(spark.createDataFrame([(p,) for p in paths], "path string"))


def write_tree(rows: DataFrame, base: str) -> int:
    """Write ``(path, text)`` rows as UTF-8 files under the local or mounted folder
    ``base`` (``path`` is absolute-looking and is appended to ``base``).  Each task
    writes its own files; a retried task rewrites the same names."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            for p, t in zip(pdf["path"], pdf["text"]):
                target = os.path.join(base, p.lstrip("/"))
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as fh:
                    fh.write((t or "").encode("utf-8"))
                n += 1
        yield pd.DataFrame({"n": [n]})

    return rows.select("path", "text").mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
