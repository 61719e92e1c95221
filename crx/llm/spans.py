"""Spans of regular-expression matches as columns, in code points.

A text split at a pattern gives what stands between the matches, so match and gap
lengths add up to the positions. Patterns use possessive loops and start only
where a run starts, so no text makes them slow; they match what their plain forms
match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:long,end:long,value:string>>"


def matches(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), end exclusive;
    with `wanted`, those whose value it holds for."""
    gaps_and_hits = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                                 F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def gone(hit: Column) -> Column:
        return hit.isNull() if wanted is None else hit.isNull() | ~wanted(hit)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("at"), F.when(gone(x["hit"]), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    found = F.aggregate(gaps_and_hits, start, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """Spans as (start, order, kind, end, value): sorting puts them by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"),
                                                 s["end"].alias("end"), s["value"].alias("value")))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
