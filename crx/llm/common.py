"""Helpers of the training-data operators: shared tables, text columns, one
range-numbering scheme for prefix sums."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crx.plans.session import ensure_checkpoint_dir, ship_package, write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table of the session's shared checkpoint folder and read
    it back: the lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(col: str) -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. `lower` does the same on pure ASCII, and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009-U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def uniform_key(*parts: Column) -> Column:
    """A hash-random 60-bit integer of the parts (null as empty)."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def key_range(key: Column, ranges: int) -> Column:
    """Number of the equal-width range, of `ranges`, that a uniform key lies in.
    Monotone in the key, so ranges in order hold the keys in order."""
    return F.least(F.floor(key.cast("double") / float(1 << 60) * ranges), F.lit(ranges - 1)).cast("long")
