"""Query parameters, result shapes and driver-side argument checks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# Column order of a finding, as documented for reports.
FINDING_COLUMNS = [
    "file_path",
    "line_number",
    "match_text",
    "char_start_in_line",
    "char_end_in_line",
    "snippet",
]

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("file_path", T.StringType(), False),
        T.StructField("line_number", T.LongType(), False),
        T.StructField("match_text", T.StringType(), False),
        T.StructField("char_start_in_line", T.LongType(), False),
        T.StructField("char_end_in_line", T.LongType(), False),
        T.StructField("snippet", T.StringType(), False),
    ]
)

# Texts that must equal the original tool's output.
SNIPPET_LINE_MISMATCH = "[Error: Could not generate snippet due to line number mismatch]"
SNIPPET_INVALID_LOCATION = "[Error: Invalid match location for snippet generation]"


@dataclass(frozen=True)
class Query:
    """One search request.

    ``text`` is a literal or a Python-dialect regular expression.  Literal,
    case-insensitive search lower-cases both sides; regex search uses
    ``re.IGNORECASE`` only (no MULTILINE, no DOTALL).
    """

    text: str
    case_sensitive: bool = False
    regex: bool = False
    context_lines: int = 3

    def __post_init__(self):
        if not isinstance(self.context_lines, int) or isinstance(self.context_lines, bool):
            raise ValueError("context_lines must be an integer")
        if self.context_lines < 0:
            raise ValueError("context_lines must be a non-negative integer")
        if self.regex:
            self.compiled()  # raises ValueError on a bad pattern

    def compiled(self) -> re.Pattern:
        flags = 0 if self.case_sensitive else re.IGNORECASE
        try:
            return re.compile(self.text, flags)
        except re.error as exc:
            raise ValueError(f"Invalid regex pattern: '{self.text}' - {exc}") from None

    @property
    def is_empty(self) -> bool:
        return not self.text

    def params(self) -> dict:
        """Canonical parameter dict, used for result-table keys."""
        return {
            "query": self.text,
            "is_case_sensitive": self.case_sensitive,
            "is_regex": self.regex,
            "context_lines": self.context_lines,
        }
