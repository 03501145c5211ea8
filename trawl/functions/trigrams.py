"""Trigrams that a text must hold for a query to match it, as a Boolean expression.

Texts are folded first: letters that case-insensitive matching takes for an ASCII letter become that letter, the
rest is lower-cased.  Folding works character by character, so what stands together in a text stands together
in its folded form.  Only trigrams of ASCII characters count; other characters end a run.

An expression is ``None`` (any text may match), a trigram code, ``("and", ...)`` or ``("or", ...)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.functions.regex_dialect import P
from trawl.model import Query

# Letters that lower() or IGNORECASE takes for an ASCII letter, and the dot that lower() leaves of "İ".
FOLD_FROM, FOLD_TO = "İıſK̇", "iisk"
#: Trigrams asked of a conjunction; a longer run gives this many, spread over it (a weaker test, never another result).
MAX_ASKED = 48


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def codes(data: bytes) -> np.ndarray:
    """Sorted distinct codes of the ASCII trigrams of a folded UTF-8 text."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) < 3:
        return np.empty(0, dtype=np.int32)
    ascii_ = b < 128
    whole = ascii_[:-2] & ascii_[1:-1] & ascii_[2:]
    wide = b.astype(np.int32)
    return np.unique(((wide[:-2] << 14) | (wide[1:-1] << 7) | wide[2:])[whole])


def _conjunction(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _of_runs(runs: list[str]) -> list[int]:
    return [int(c) for run in runs for c in codes(run.encode("ascii"))]


def _of_tokens(tokens):
    """What a sequence of parsed regex items asks for."""
    runs, inner, run = [], [], ""
    for op, av in tokens:
        if op is P.LITERAL and av < 128:
            run += chr(av).lower()
            continue
        if op is P.AT:
            continue  # takes no character
        runs.append(run)
        run = ""
        if op is P.SUBPATTERN:
            inner.append(_of_tokens(av[-1]))
        elif op in (P.MAX_REPEAT, P.MIN_REPEAT) and av[0] >= 1:
            inner.append(_of_tokens(av[2]))
        elif op is P.BRANCH:
            ways = [_of_tokens(way) for way in av[1]]
            if all(way is not None for way in ways):
                ways = list(dict.fromkeys(ways))
                inner.append(ways[0] if len(ways) == 1 else ("or", *ways))
    asked = _of_runs([*runs, run])
    if len(asked) > MAX_ASKED:
        asked = [asked[i * len(asked) // MAX_ASKED] for i in range(MAX_ASKED)]
    return _conjunction(asked + inner)


def trigram_query(query: Query):
    """The expression that every matching text satisfies."""
    if query.regex:
        return _of_tokens(P.parse(query.text, query.compiled().flags))
    text = query.text.translate(str.maketrans(dict(zip(FOLD_FROM, [*FOLD_TO, ""]))))
    return _of_tokens([(P.LITERAL, ord(c)) if c.isascii() else (P.ANY, None) for c in text])


def asked_codes(expression) -> set[int]:
    if expression is None:
        return set()
    if isinstance(expression, tuple):
        return set().union(*(asked_codes(part) for part in expression[1:]))
    return {expression}


def evaluate(expression, postings: dict[int, np.ndarray]) -> np.ndarray:
    """Sorted members that satisfy an expression (not ``None``)."""
    if not isinstance(expression, tuple):
        return postings.get(expression, np.empty(0, dtype=np.int64))
    parts = (evaluate(part, postings) for part in expression[1:])
    found = next(parts)
    for part in parts:
        found = np.intersect1d(found, part, assume_unique=True) if expression[0] == "and" else np.union1d(found, part)
    return found
