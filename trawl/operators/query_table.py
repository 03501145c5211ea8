"""Many queries at once, given as a table: one pass over the corpus however many there are.

All literals go into an Aho-Corasick automaton (one for case-sensitive queries, one for the rest,
which reads lower-cased text): a pass over a text tells every place where the first
``KEY_CHARS`` characters of some literal stand, and the whole literal is compared there.  A regex is
looked up by a literal that all its matches hold, in the same automata, and only run on the
texts that hold it; regexes without one run on every text.  The findings of each query are those
that it has alone (:func:`trawl.operators.match.iter_findings`).

The automaton travels as the list of queries and is built once per Python worker.  A table
beyond ``BLOCK_CHARS`` characters is cut into blocks, each a pass of its own, so that what a worker
holds is bounded and the plan does not grow with the number of queries in a block.
"""

from __future__ import annotations

import uuid
from typing import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.regex_dialect import ignores_case, required_literal
from trawl.model import FINDING_COLUMNS, FINDING_SCHEMA, Query
from trawl.operators.match import ROUTE_CHARS, ROUTE_ROWS, locate

KEY_CHARS = 32
BLOCK_CHARS = 4_000_000
SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), *FINDING_SCHEMA.fields])

# Letters that Python's IGNORECASE takes for an ASCII letter although lower() does not.
_ASCII_LIKE = str.maketrans({"İ": "i", "ı": "i", "ſ": "s"})


class Matcher:
    """The automata of a list of (query_id, Query)."""

    def __init__(self, queries: list[tuple[int, Query]]):
        self.queries = [(no, q) for no, q in queries if not q.is_empty]
        self.patterns = {i: q.compiled() for i, (_, q) in enumerate(self.queries) if q.regex}
        keys: tuple[dict, dict] = ({}, {})  # by case: key to the queries that begin with it
        self.needles, self.open = {}, []
        for i, (_, q) in enumerate(self.queries):
            folded = ignores_case(q) if q.regex else not q.case_sensitive
            needle = required_literal(q) if q.regex else q.text.lower() if folded else q.text
            if not needle:
                self.open.append(i)  # a regex without a literal to look up
                continue
            self.needles[i] = needle
            keys[folded].setdefault(needle[:KEY_CHARS], []).append(i)
        self.automata = []
        for words in keys:
            automaton = ahocorasick.Automaton()
            for key, found in words.items():
                automaton.add_word(key, (len(key), found))
            automaton.make_automaton()
            self.automata.append(automaton if words else None)

    def _starts(self, hay: str, automaton, wanted) -> Iterator[tuple[int, int]]:
        """(query, start) of every occurrence in ``hay`` of the literals of ``wanted`` queries."""
        for end, (size, found) in automaton.iter(hay):
            start = end - size + 1
            for i in found:
                if wanted(i) and (len(self.needles[i]) <= size or hay.startswith(self.needles[i], start)):
                    yield i, start

    def occurrences(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(query, start, matched text) for every query, in order of start for each."""
        runs = list(self.open)
        for folded, automaton in enumerate(self.automata):
            if automaton is None:
                continue
            hay = text.lower() if folded else text
            free: dict[int, int] = {}
            for i, start in self._starts(hay, automaton, lambda i: i not in self.patterns):
                if start >= free.get(i, 0):  # occurrences of one query do not overlap
                    size = len(self.queries[i][1].text)
                    free[i] = start + size
                    yield i, start, text[start : start + size]
            if self.patterns:
                like = hay if not folded or text.isascii() else text.translate(_ASCII_LIKE).lower()
                runs += {i for i, _ in self._starts(like, automaton, self.patterns.__contains__)}
        for i in runs:
            for m in self.patterns[i].finditer(text):
                yield i, m.start(), m.group(0)


_BUILT: dict[str, Matcher] = {}


def _pass(corpus: DataFrame, queries: list[tuple], context: int) -> DataFrame:
    token = uuid.uuid4().hex
    shared = corpus.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _BUILT:  # one at a time: a worker serves many tasks of one pass
            _BUILT.clear()
            _BUILT[token] = Matcher([(no, Query(text, bool(case), bool(regex), context)) for no, text, case, regex in shared.value])
        matcher = _BUILT[token]
        rows, chars = [], 0
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["text"]):
                place = None
                for i, start, matched in matcher.occurrences(text):
                    place = place or locate(text, context)
                    row = (matcher.queries[i][0], path, *place(start, matched))
                    rows.append(row)
                    chars += len(row[3]) + len(row[6])
                    if len(rows) >= ROUTE_ROWS or chars >= ROUTE_CHARS:
                        yield pd.DataFrame.from_records(rows, columns=SCHEMA.names)
                        rows, chars = [], 0
        if rows:
            yield pd.DataFrame.from_records(rows, columns=SCHEMA.names)

    return corpus.select("path", "text").mapInPandas(run, SCHEMA)


def _blocks(queries: DataFrame) -> list[list[tuple]]:
    """The rows of ``queries`` in blocks of about ``BLOCK_CHARS`` characters."""
    size = queries.agg(F.coalesce(F.sum(F.length("query")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-size[0] // BLOCK_CHARS), -(-size[1] * 8 // BLOCK_CHARS))
    if n == 1:
        return [[tuple(r) for r in queries.collect()]]
    tagged = queries.withColumn("_block", F.pmod(F.xxhash64("query_id", "query"), F.lit(n)))
    return [[tuple(r) for r in tagged.where(F.col("_block") == b).drop("_block").collect()] for b in range(n)]


def search_query_table(corpus: DataFrame, queries: DataFrame, context_lines: int = 3) -> DataFrame:
    """Findings of every row of ``queries`` over ``corpus``, with its ``query_id``.

    ``queries`` has ``query_id`` and ``query`` and may have ``is_case_sensitive`` and ``is_regex`` (both false if
    missing or null).  Rows with a null or empty query find nothing; a bad regex raises ``ValueError`` here."""
    from trawl.plans.search import searchable, spread

    given = {c.lower() for c in queries.columns}
    flags = [
        F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) if c in given else F.lit(False).alias(c)
        for c in ("is_case_sensitive", "is_regex")
    ]
    slim = queries.select(F.col("query_id").cast("long"), F.col("query"), *flags).where(F.length("query") > 0)
    out = None
    for block in _blocks(slim):
        for _, text, case, regex in block:
            Query(text, case, regex, context_lines)  # raises on a bad pattern
        found = _pass(spread(searchable(corpus)), block, context_lines)
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", *FINDING_COLUMNS)
