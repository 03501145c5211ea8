"""Column expressions for lines, numbering and literal patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's str.splitlines(), as a Java regex.
SPLITLINES_PATTERN = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


# Line boundaries other than "\n" (if a text has none, its lines are its "\n" pieces).
OTHER_BOUNDARIES = r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def _drop_empty_tail(pieces: Column) -> Column:
    return F.when(F.element_at(pieces, -1) == F.lit(""), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def splitlines(text: Column, newline_pieces: Column | None = None) -> Column:
    """``text.splitlines()``: split on every line boundary, drop one empty tail piece.

    With ``newline_pieces`` (the text split on ``\n``) the regex split is only done
    for texts that hold another boundary character."""
    full = _drop_empty_tail(F.split(text, SPLITLINES_PATTERN, -1))
    if newline_pieces is None:
        return full
    return F.when(text.rlike(OTHER_BOUNDARIES), full).otherwise(_drop_empty_tail(newline_pieces))


def newline_lines(text: Column) -> Column:
    """Lines as numbered by match positions: pieces between ``\\n`` characters only."""
    return F.split(text, "\n", -1)


def number_prefix(n: Column) -> Column:
    """``'{n: >4}: '`` (pads to four, never truncates; ``lpad`` alone would cut)."""
    digits = n.cast("string")
    return F.concat(F.when(n < 10000, F.lpad(digits, 4, " ")).otherwise(digits), F.lit(": "))


def java_literal(s: str) -> str:
    """A Java regex that matches ``s`` literally (backslash before every ASCII symbol)."""
    out = []
    for ch in s:
        if ch.isascii() and not ch.isalnum():
            out.append("\\" + ch if ch not in "\n\t\r" else {"\n": "\\n", "\t": "\\t", "\r": "\\r"}[ch])
        else:
            out.append(ch)
    return "".join(out)


def highlight(line: Column, start: Column, end: Column) -> Column:
    """``line`` with ``>>>`` / ``<<<`` around ``[start, end)``, both clipped to the line."""
    n = F.length(line)
    b = F.least(end, n)
    a = F.least(F.least(start, n), b)
    return F.concat(
        line.substr(F.lit(1), a),
        F.lit(">>>"),
        line.substr(a + 1, b - a),
        F.lit("<<<"),
        line.substr(b + 1, n - b),
    )
