"""Column helpers shared by operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order of the findings list (unknown severities sort last).
SEVERITY_RANK = {"critical": 0, "warning": 1, "suggestion": 2}
SEVERITY_UNKNOWN_RANK = 99
# Minimum confidence per severity; any other severity needs 0.9.
CONFIDENCE_THRESHOLDS = {"critical": 0.6, "warning": 0.8, "suggestion": 0.9}
CONFIDENCE_DEFAULT_THRESHOLD = 0.9


def severity_rank(sev: Column) -> Column:
    expr = F.lit(SEVERITY_UNKNOWN_RANK)
    for name, rank in reversed(list(SEVERITY_RANK.items())):
        expr = F.when(sev == name, F.lit(rank)).otherwise(expr)
    return expr


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def round_half_even_ratio(num: Column, den: Column, digits: int = 1) -> Column:
    """round(num/den, digits) with ties to even, computed on integers so no
    binary-double artefact decides a tie. 0 when den is 0."""
    scale = 10 ** digits
    scaled = num.cast("long") * scale
    den = den.cast("long")
    rem = F.pmod(scaled, den)
    q = ((scaled - rem) / den).cast("long")
    up = (F.when(rem * 2 > den, q + 1)
           .when(rem * 2 < den, q)
           .otherwise(q + q % 2))
    return F.when(den == 0, F.lit(0.0)).otherwise(up.cast("double") / scale)


def ntz_to_instant(ts_ntz: Column) -> Column:
    """A TIMESTAMP_NTZ wall-clock value as the TIMESTAMP instant with the same
    UTC reading, independent of the session time zone (watermarks and
    windows need TIMESTAMP)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts_ntz)
    return F.timestamp_micros(micros)


def instant_utc_date(ts: Column) -> Column:
    """The UTC calendar date of an instant, independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / 86_400_000_000).cast("int"))
