"""Text helpers with Python string semantics, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line boundaries of Python's str.splitlines.
SPLITLINES_RE = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
# Characters Python's str.split()/strip() treat as whitespace.
PY_WS_CLASS = "[\\s\\u001c-\\u001f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def splitlines(text: Column) -> Column:
    """Array of lines as Python's `str.splitlines()` gives them: no trailing
    empty element, empty text gives an empty array."""
    parts = F.split(text, SPLITLINES_RE, -1)
    return F.when(F.element_at(parts, -1) == "",
                  F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    return F.size(splitlines(F.coalesce(text, F.lit(""))))


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"^{PY_WS_CLASS}*$")


def py_split_ws(text: Column) -> Column:
    """Tokens of Python's `str.split()` (runs of whitespace, ends stripped)."""
    stripped = F.regexp_replace(text, f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, f"{PY_WS_CLASS}+", -1))


def estimate_tokens(text: Column) -> Column:
    """max(1, len // 4) in code points."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


TRUNCATION_MARK = "\n... [truncated]"


def truncate_text(text: Column, max_tokens: Column) -> Column:
    """If longer than 4 * max_tokens characters, cut there and append the mark."""
    max_chars = (max_tokens * 4).cast("int")
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(text.substr(F.lit(1), max_chars), F.lit(TRUNCATION_MARK)))
