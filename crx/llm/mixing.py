"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are sorted in ranges within each
source; range totals give distributed prefix sums of word counts, and each
source is cut at its exact budget, whole epochs first. All joins and windows
work on (source, range), so a source holding a third of the rows is spread over
as many ranges as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crx.llm.common import WORD_RE, key_range, shared_table, shuffle_width, text_of, uniform_key, word_count

ROWS_PER_RANGE = 50_000


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source: source_size and target. `totals` has one row per source
    (skey, source, source_size). Sources in code-point order, null last, take the
    weights in turn; targets share `share` of all sizes by weight, none above
    `max_epochs` times its source, the excess reshared until none is above.

    In the order of cap / weight the capped sources come first, so the level at
    which the others stop is the first one whose own cap isn't reached.
    One row per source: this is the only step that sees all of them at once."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_level = Window.orderBy("cap_level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.col("all_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    return (totals.withColumn("weight", pick)
            .withColumn("cap", F.col("source_size") * float(max_epochs))
            .withColumn("budget", F.sum("source_size").over(everything) * float(share))
            .withColumn("all_weights", F.sum("weight").over(everything))
            .withColumn("cap_level", F.col("cap") / F.col("weight"))
            .withColumn("level", level)
            .withColumn("stop", F.first(F.when(F.col("cap_level") > F.col("level"), F.col("level")), ignorenulls=True)
                        .over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .select("skey", "source_size",
                    F.coalesce(F.least("cap", F.col("stop") * F.col("weight")), F.col("cap")).alias("target")))


def _take(size: Column, before: Column, total: Column, budget: Column) -> Column:
    """Words a document gives: whole epochs of its source, then what lies before the cut."""
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(F.lit(0)).cast("long")
    left = budget - epochs * total
    return epochs * size + F.least(F.greatest(left - before, F.lit(0).cast("long")), size)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
            seed: int = 7, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per input row: doc_id, source, text_hash, size, source_size, target, taken.

    A null text has size 0, a null source is a source of its own. Documents of
    equal key (a repeated row) are ordered by id, size and text hash; rows equal
    in all of these are interchangeable. A source without words has target 0 and
    takes nothing. An empty table gives an empty result; other columns are ignored."""
    text = text_of(text_col)
    sizes = shared_table(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), source_col)).alias("skey"),
                    F.xxhash64(text).alias("text_hash"), word_count(text).alias("size"),
                    uniform_key(F.lit(seed), F.col(id_col)).alias("key")), "mix-sizes")
    ranges = max(shuffle_width(docs), -(-sizes.count() // rows_per_range))  # a hot source is spread over all of them
    rows = sizes.withColumn("range_no", key_range(F.col("key"), ranges))
    per_range = rows.groupBy("skey", "range_no").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    totals = per_range.groupBy("skey").agg(F.sum("range_size").alias("source_size"), F.first("source").alias("source"))
    earlier = Window.partitionBy("skey").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_range.withColumn("range_before", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
               .join(source_targets(totals, weights, share, max_epochs), "skey")
               .select("skey", "range_no", "range_before", "source_size", "target"))
    inside = (Window.partitionBy("skey", "range_no").orderBy("key", "doc_id", "size", "text_hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets, ["skey", "range_no"]))
    taken = _take(F.col("size"), F.col("before") + F.col("range_before"), F.col("source_size"),
                  F.round("target").cast("long"))
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  count_col: str | None = "n_chars", **params) -> DataFrame:
    """The mixed documents, with the columns of `docs`: a document is repeated
    once per whole epoch; the one at a source's cut comes once more with the words
    before the cut, joined by spaces (`count_col`, if the table has it, is then its
    new length)."""
    def row_key(doc_id: Column, text_hash: Column, source: Column) -> Column:
        return F.md5(F.to_json(F.struct(doc_id.alias("i"), text_hash.alias("h"), source.alias("s"))))

    plan = (mixture(docs, id_col, text_col, source_col, **params)
            .groupBy(row_key(F.col("doc_id"), F.col("text_hash"), F.col("source")).alias("mix_key"))
            .agg(F.max("size").alias("size"), F.collect_list("taken").alias("takes")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       row_key(F.col(id_col), F.xxhash64(text_of(text_col)), F.col(source_col)).alias("mix_key"))
    # rows that share a key (a repeated row) have one entry of its takes each
    twin = F.row_number().over(Window.partitionBy("mix_key").orderBy("mix_key"))
    joined = rows.join(plan, "mix_key").withColumn("taken", F.element_at("takes", twin))
    return _expand(joined, docs.columns, text_col, count_col)


def _expand(joined: DataFrame, columns: list[str], text_col: str, count_col: str | None) -> DataFrame:
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    copies = (joined.withColumn("whole", whole).withColumn("rest", F.col("taken") - F.col("whole") * F.col("size")))
    n_out = F.col("whole") + (F.col("rest") > 0).cast("int")
    copies = copies.filter(n_out > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n_out)))
    kept_words = F.regexp_extract_all(F.col(f"row.`{text_col}`"), F.lit(WORD_RE), F.lit(0))
    cut = F.array_join(F.slice(kept_words, F.lit(1), F.col("rest").cast("int")), " ")
    text = F.when(F.col("copy") <= F.col("whole"), F.col(f"row.`{text_col}`")).otherwise(cut)
    out = []
    for c in columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == count_col:
            out.append(F.when(F.col("copy") <= F.col("whole"), F.col(f"row.`{c}`"))
                       .otherwise(F.length(cut).cast("long")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return copies.select(*out)
