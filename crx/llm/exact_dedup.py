"""Exact deduplication by 128-bit content hash, bytes compared inside groups.

Grouping is on (md5, normalised text), so texts that share a hash are still told
apart by their bytes; the partial aggregate keeps one copy of each text per task,
so a group of any size reaches the shuffle as one row per task. Documents then
find their group by (md5, sha-256), never by moving their text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.llm.common import ascii_lower, text_of


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(text_of(text_col))
    return (docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
            .select("doc_id", "norm", F.unhex(F.md5("norm")).alias("hash128"),
                    F.sha2("norm", 256).alias("text_sha256")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is the
    empty text, and empty texts form one group. `keep` is "min" or "max": the
    smallest or largest id of the group stays (null ids never, unless the group
    has no other; then keep_id is null and no row is kept). A repeated row counts
    in group_size as often as it occurs, and each occurrence of the kept id says
    kept. An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    pick = F.min if keep == "min" else F.max
    keyed = _keyed(docs, id_col, text_col)
    groups = (keyed.groupBy("hash128", "norm")
              .agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))
              .select("hash128", F.sha2("norm", 256).alias("text_sha256"), "group_size", "keep_id"))
    return (keyed.select("doc_id", "hash128", "text_sha256")
            .join(groups, ["hash128", "text_sha256"])
            .select("doc_id", "keep_id", "group_size",
                    F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
                    "text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      keep: str = "min") -> DataFrame:
    """The documents with one row left of each group, all columns kept. The row
    with the smallest (or largest) id stays; of rows that share that id too, one
    stays. Clashing extra columns do no harm: rows travel as one struct."""
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be 'min' or 'max', not {keep!r}")
    pick = F.min_by if keep == "min" else F.max_by
    norm = ascii_lower(text_of(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       norm.alias("norm"), F.col(id_col).alias("rank"))
    best = (rows.select("row", "norm", "rank", F.unhex(F.md5("norm")).alias("hash128"))
            .groupBy("hash128", "norm").agg(F.coalesce(pick("row", "rank"), F.first("row")).alias("row")))
    return best.select("row.*")
