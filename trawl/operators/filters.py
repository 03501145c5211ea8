"""Corpus filters: hidden paths, excluded directories and files, binary files.

All rules are column expressions over a listing ``(path, root, ...)`` and run inside
the scan's generated code: no Python, no shuffle.  Path rules only need the path, so
they run before any content is read; the content probes only read the first 1 KB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.paths import basename, extension, glob_match, parts, relative_path

# Default exclusions of the original tool.
DEFAULT_EXCLUDED_DIRS = [".git", "__pycache__", "venv", "node_modules", ".hg", ".svn"]
DEFAULT_EXCLUDED_FILES = ["*.log", "*.tmp", "*.swp", "*.bak"]
DEFAULT_BINARY_EXTENSIONS = [
    # compiled code
    ".pyc", ".pyo", ".o", ".so", ".obj", ".dll", ".exe", ".class", ".jar",
    # archives
    ".zip", ".tar", ".gz", ".bz2", ".rar", ".7z", ".iso",
    # images
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".ico",
    # audio / video
    ".mp3", ".wav", ".ogg", ".mp4", ".avi", ".mov", ".flv", ".mkv",
    # documents
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".odt",
    # other
    ".db", ".sqlite", ".dat",
]
# The server front end adds these custom patterns (build outputs).
SERVER_CUSTOM_PATTERNS = ["target", "build", "dist"]
# Bytes counted as text by the binary probe, and its limits.
TEXT_BYTES_CLASS = r"[\x20-\x7E\n\r\t\x08]"
PROBE_BYTES = 1024
NONTEXT_RATIO = 0.30


@dataclass(frozen=True)
class PathRules:
    """What to leave out of a corpus (``None`` lists mean the defaults)."""

    excluded_dirs: tuple = tuple(DEFAULT_EXCLUDED_DIRS)
    excluded_files: tuple = tuple(DEFAULT_EXCLUDED_FILES)
    binary_extensions: tuple = tuple(DEFAULT_BINARY_EXTENSIONS)
    custom_patterns: tuple = field(default_factory=tuple)
    exclude_dot_items: bool = True

    @classmethod
    def server(cls, include_hidden: bool = False) -> "PathRules":
        return cls(custom_patterns=tuple(SERVER_CUSTOM_PATTERNS), exclude_dot_items=not include_hidden)


def _rel(root: Column | str | None) -> Column:
    path = F.col("path")
    if root is None:
        root = F.col("root")
    elif isinstance(root, str):
        root = F.lit(root)
    return relative_path(path, root)


def hidden(rel: Column) -> Column:
    """some part of the relative path starts with '.' (but is not '.' or '..')."""
    return F.exists(parts(rel), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def _ancestors(rel: Column) -> Column:
    """Relative paths of the directories between the root and the file."""
    ps = parts(rel)
    return F.transform(
        F.slice(ps, 1, F.greatest(F.size(ps) - 1, F.lit(0))),
        lambda _p, i: F.array_join(F.slice(ps, 1, i + 1), "/"),
    )


def dir_excluded(d: Column, rules: PathRules) -> Column:
    """F2 + F4 for one directory given by its relative path: excluded name (exact), or a
    custom pattern on its name or relative path (``x/`` and ``x/*`` also hit ``x``)."""
    name = basename(d)
    cond = name.isin(*rules.excluded_dirs) if rules.excluded_dirs else F.lit(False)
    for pat in rules.custom_patterns:
        stripped = pat.rstrip("/")
        cond = cond | glob_match(name, stripped) | glob_match(d, stripped)
        if pat.endswith("/*"):
            cond = cond | glob_match(d, pat[:-2])
    return cond


def excluded_dir(rel: Column, rules: PathRules) -> Column:
    """Some ancestor directory of the file (below the root) is excluded."""
    return F.exists(_ancestors(rel), lambda d: dir_excluded(d, rules))


def excluded_file(rel: Column, rules: PathRules) -> Column:
    """F3 + F5: the file's name matches an excluded glob, or a custom file pattern
    matches its name or relative path (patterns ending in '/' are directory-only)."""
    name = basename(rel)
    cond = F.lit(False)
    for pat in rules.excluded_files:
        cond = cond | glob_match(name, pat)
    for pat in rules.custom_patterns:
        if pat.endswith("/"):
            continue
        cond = cond | glob_match(name, pat) | glob_match(rel, pat)
    return cond


def binary_by_extension(path: Column, rules: PathRules) -> Column:
    """F6."""
    exts = [e.lower() for e in rules.binary_extensions]
    return extension(path).isin(*exts) if exts else F.lit(False)


def excluded(rules: PathRules, root: Column | str | None = None, path_binary: bool = True) -> Column:
    """Every path-only rule (F1-F6) for each row; ``root`` defaults to the ``root`` column."""
    rel = _rel(root)
    cond = excluded_dir(rel, rules) | excluded_file(rel, rules)
    if rules.exclude_dot_items:
        cond = cond | hidden(rel)
    if path_binary:
        cond = cond | binary_by_extension(F.col("path"), rules)
    return cond


def filter_paths(listing: DataFrame, rules: PathRules = PathRules(), root: Column | str | None = None) -> DataFrame:
    """Keep the rows whose path passes F1-F6."""
    return listing.where(~excluded(rules, root))


# --------------------------------------------------------------------- content probes


def probe(content: Column) -> Column:
    """The first 1 KB of the content (binary)."""
    return F.substring(content, 1, PROBE_BYTES)


def has_nul(chunk: Column) -> Column:
    """F7."""
    return F.locate("\u0000", F.decode(chunk, "ISO-8859-1")) > 0


def nontext_share(chunk: Column) -> Column:
    """Share of bytes outside printable ASCII and \\n \\r \\t \\b (F8)."""
    s = F.decode(chunk, "ISO-8859-1")
    return F.length(F.regexp_replace(s, TEXT_BYTES_CLASS, "")) / F.length(s)


def binary_by_content(content: Column) -> Column:
    """NUL byte or more than 30% non-text bytes in the first 1 KB.  Empty or
    unreadable (null) content counts as text."""
    chunk = probe(content)
    return (
        F.when(content.isNull(), F.lit(False))
        .when(F.length(chunk) == 0, F.lit(False))
        .otherwise(has_nul(chunk) | (nontext_share(chunk) > NONTEXT_RATIO))
    )


def drop_binary(files: DataFrame, rules: PathRules = PathRules()) -> DataFrame:
    """Remove binary files: extension first (free), then the content probe."""
    return files.where(~binary_by_extension(F.col("path"), rules)).where(~binary_by_content(F.col("content")))
