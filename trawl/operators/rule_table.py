"""Path rules given as a table: one pass over a listing however many there are.

A rule is ``(rule_id, kind, pattern)``:

* ``dir``: an exact directory name, as in ``PathRules.excluded_dirs``;
* ``file``: a glob on the file's name, as in ``PathRules.excluded_files``;
* ``custom``: a glob on the name or the relative path of the file or of a directory above it, as in
  ``PathRules.custom_patterns`` (``x/`` is for directories only, ``x/*`` also hits the directory ``x``).

Patterns without a wildcard are looked up in a hash table.  A glob is looked up by one of its literal runs, the one
that the fewest globs share, in an Aho-Corasick automaton that reads each path once; only globs whose run stands
in the path are compared whole.  Globs without a literal run are compared with every path.  What holds for a
directory is kept for the other files in it.

The rules travel to the workers as a list and the automaton is built once per worker; a table beyond
``BLOCK_CHARS`` characters is cut into blocks, so the plan does not grow with the number of rules in a block.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections import Counter
from functools import lru_cache
from typing import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.paths import relative_path

KINDS = ("dir", "file", "custom")
BLOCK_CHARS = 4_000_000
#: Directories whose rule a worker keeps.
KEPT_DIRS = 100_000
_WILD = re.compile(r"[*?]+|\[!?\]?[^\]]*\]")
NONE = float("inf")


#: Compiled globs a worker keeps; a glob is compiled when a path holds its literal run for the first time.
KEPT_GLOBS = 50_000


@lru_cache(maxsize=KEPT_GLOBS)
def _compiled(glob: str) -> re.Pattern:
    return re.compile(fnmatch.translate(glob))


class Globs:
    """The smallest rule whose glob matches one of some strings that all end in the last characters of the first."""

    def __init__(self, rules: Iterable[tuple[int, str]]):
        self.exact: dict[str, float] = {}
        self.open: list[tuple[float, str]] = []
        globs = []
        for no, pattern in rules:
            if not pattern:
                continue
            if not any(ch in pattern for ch in "*?["):
                self.exact[pattern] = min(no, self.exact.get(pattern, NONE))
                continue
            globs.append((no, pattern, [run for run in _WILD.split(pattern) if run and "[" not in run]))
        shared = Counter(run for _, _, runs in globs for run in set(runs))
        keyed: dict[str, list] = {}
        for no, pattern, runs in globs:
            rule = (no, pattern)
            if runs:
                keyed.setdefault(min(runs, key=lambda r: (shared[r], -len(r))), []).append(rule)
            else:
                self.open.append(rule)
        self.automaton = None
        if keyed:
            self.automaton = ahocorasick.Automaton()
            for run, found in keyed.items():
                self.automaton.add_word(run, sorted(found, key=lambda r: r[0]))
            self.automaton.make_automaton()

    def first(self, whole: str, *names: str) -> float:
        """The smallest rule that matches ``whole`` or one of ``names``, which are parts of it."""
        strings = (whole, *names)
        best = min((self.exact.get(s, NONE) for s in strings), default=NONE)
        groups = [self.open] if self.open else []
        if self.automaton is not None:
            groups += {id(found): found for _, found in self.automaton.iter(whole)}.values()
        for found in groups:
            for no, glob in found:
                if no < best and any(_compiled(glob).match(s) for s in strings):
                    best = no
        return best


class RuleMatcher:
    """The smallest rule that excludes a relative path."""

    def __init__(self, rules: list[tuple[int, str, str]]):
        custom = [(no, p) for no, kind, p in rules if kind == "custom"]
        self.names: dict[str, float] = {}
        for no, kind, p in rules:
            if kind == "dir":
                self.names[p] = min(no, self.names.get(p, NONE))
        self.on_dirs = Globs((no, p.rstrip("/")) for no, p in custom)
        self.under = Globs((no, p[:-2]) for no, p in custom if p.endswith("/*"))
        self.on_name = Globs((no, p) for no, kind, p in rules if kind == "file")
        self.on_file = Globs((no, p) for no, p in custom if not p.endswith("/"))
        self.dirs: dict[str, float] = {}

    def of_dir(self, rel: str) -> float:
        """The smallest rule that excludes the directory or one above it."""
        above: list[str] = []
        best = NONE
        while rel not in self.dirs:
            above.append(rel)
            if "/" not in rel:
                break
            rel = rel.rpartition("/")[0]
        else:
            best = self.dirs[rel]
        if len(self.dirs) > KEPT_DIRS:
            self.dirs.clear()
        for d in reversed(above):
            name = d.rpartition("/")[2]
            best = min(best, self.names.get(name, NONE), self.on_dirs.first(d, name), self.under.first(d))
            self.dirs[d] = best
        return best

    def of_file(self, rel: str) -> int | None:
        folder, slash, name = rel.rpartition("/")
        best = min(self.of_dir(folder) if slash else NONE, self.on_name.first(name), self.on_file.first(rel, name))
        return None if best == NONE else int(best)


_BUILT: dict[str, RuleMatcher] = {}


def _matcher(listing: DataFrame, rules: list[tuple]):
    token = uuid.uuid4().hex
    shared = listing.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf(T.LongType())
    def excluded_by(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if token not in _BUILT:
            if len(_BUILT) > 3:  # a worker serves few passes at a time
                _BUILT.clear()
            _BUILT[token] = RuleMatcher(shared.value)
        of_file = _BUILT[token].of_file
        for rels in batches:
            yield pd.Series([None if r is None else of_file(r) for r in rels], dtype="Int64")

    return excluded_by


def _blocks(rules: DataFrame) -> list[list[tuple]]:
    size = rules.agg(F.coalesce(F.sum(F.length("pattern") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_CHARS))
    if n == 1:
        return [[tuple(r) for r in rules.collect()]]
    tagged = rules.withColumn("_block", F.pmod(F.xxhash64("rule_id", "pattern"), F.lit(n)))
    return [[tuple(r) for r in tagged.where(F.col("_block") == b).drop("_block").collect()] for b in range(n)]


def with_excluding_rule(listing: DataFrame, rules: DataFrame, root: Column | None = None, into: str = "excluded_by") -> DataFrame:
    """``listing`` with the smallest ``rule_id`` that excludes each path, null where none does.

    ``listing`` has ``path`` and ``root`` (or ``root`` is given as a column).  A null path is excluded by no rule; rules
    with a null id, kind or pattern or an empty pattern match nothing; an unknown kind raises ``ValueError``."""
    slim = rules.select(F.col("rule_id").cast("long").alias("rule_id"), "kind", "pattern")
    slim = slim.where(F.col("rule_id").isNotNull() & F.col("kind").isNotNull() & (F.length("pattern") > 0))
    rel = relative_path(F.col("path"), F.col("root") if root is None else root)
    found = []
    for block in _blocks(slim):
        unknown = {kind for _, kind, _ in block} - set(KINDS)
        if unknown:
            raise ValueError(f"unknown kinds of rules: {sorted(unknown)}")
        found.append(_matcher(listing, block)(rel))
    return listing.withColumn(into, found[0] if len(found) == 1 else F.least(*found))


def filter_by_rules(listing: DataFrame, rules: DataFrame, root: Column | None = None) -> DataFrame:
    """The rows of ``listing`` that no rule excludes."""
    into = "_rule"
    while into in listing.columns:
        into += "_"
    return with_excluding_rule(listing, rules, root, into).where(F.col(into).isNull()).drop(into)
