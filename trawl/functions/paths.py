"""Path helpers as column expressions: relative path, parts, basename, extension, globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_java(pattern: str) -> str:
    """A shell glob (``fnmatch`` rules: ``*`` also crosses ``/``, ``?``, ``[...]``,
    ``[!...]``) as an anchored Java regex.  Case-sensitive, as on POSIX."""
    out = ["(?s)^"]
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            while i < n and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:  # no closing bracket: a literal '['
                out.append("\\[")
                continue
            body = pattern[i:j]
            i = j + 1
            negate = body.startswith("!")
            if negate:
                body = body[1:]
            members = []
            k = 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    lo, hi = body[k], body[k + 2]
                    if lo <= hi:
                        members.append(f"\\x{{{ord(lo):X}}}-\\x{{{ord(hi):X}}}")
                    k += 3
                else:
                    members.append(f"\\x{{{ord(body[k]):X}}}")
                    k += 1
            if not members:
                out.append("[^\\s\\S]" if not negate else "[\\s\\S]")
            else:
                out.append(("[^" if negate else "[") + "".join(members) + "]")
        else:
            out.append(ch if ch.isalnum() and ch.isascii() else f"\\x{{{ord(ch):X}}}")
    out.append("\\z")
    return "".join(out)


def glob_match(col: Column, pattern: str) -> Column:
    return col.rlike(glob_to_java(pattern))


def relative_path(path: Column, root: Column) -> Column:
    """``os.path.relpath(path, root)`` for a path under ``root`` (``'.'`` for the root)."""
    r = F.regexp_replace(root, "/+$", "")
    return (
        F.when(path == r, F.lit("."))
        .when(path.startswith(F.concat(r, F.lit("/"))), path.substr(F.length(r) + 2, F.length(path)))
        .otherwise(path)
    )


def parts(rel: Column) -> Column:
    return F.split(rel, "/", -1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """``os.path.splitext(path)[1].lower()``: leading dots of the name do not start it."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))
