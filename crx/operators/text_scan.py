"""Corpus scans over free text (§2.4 declared-only duplicate rule, §2.5
secret scan re-aimed at documents). Whole texts are split into lines; nothing
is truncated or sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crx.functions.text import PY_WS_CLASS, splitlines
from crx.operators.code.python import PLACEHOLDER_VALUES, SECRET_WORDS

DUP_WINDOW = 3
# `name = "value"` / `name = 'value'` assignments anywhere in a line
ASSIGN_DQ = r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"]*)"'
ASSIGN_SQ = r"([A-Za-z_][A-Za-z0-9_]*)\s*=\s*'([^']*)'"


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.posexplode(splitlines(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "line")) \
               .withColumn("line_no", F.col("pos") + 1).drop("pos")


def normalise_line(line) -> F.Column:
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def duplicate_blocks(docs: DataFrame, window: int = DUP_WINDOW) -> DataFrame:
    """Maximal repeated blocks: runs of non-blank normalised lines, at least `window`
    of them, that occur more than once in the corpus. One row per occurrence: doc_id,
    line_start, line_end, n_lines, block_hash (of the first window), occurrences.

    Windows of `window` lines are counted over the corpus, then those one line longer.
    Two neighbouring windows belong to one block if both occur as often as the two
    together, so that wherever one stands the other does. A block is an island of
    such links: it can't be extended without losing an occurrence.

    Windows are made inside a document's line array, so lines are never shuffled. A
    window's identity is two independent hashes of its text, 64 and 128 bits. Counting is
    a partial aggregate on them, and occurrences join back on it, so a block repeated
    across a third of the corpus is a skewed join key that AQE splits, never a group
    gathered into one task; no pair of occurrences is made. Document ids are unique."""
    lines = F.transform(splitlines(F.coalesce(F.col("text"), F.lit(""))),
                        lambda x, i: F.struct(normalise_line(x).alias("norm"), (i + 1).alias("line_no")))
    kept = docs.select("doc_id", F.filter(lines, lambda s: s["norm"] != "").alias("kept"))

    def text(i, n):
        return F.concat_ws("\n", *[F.element_at("kept", i + j)["norm"] for j in range(n)])
    last = F.size("kept") - (window - 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(
        i.alias("i"), F.element_at("kept", i)["line_no"].alias("line_start"), F.element_at("kept", i + (window - 1))["line_no"].alias("line_end"),
        text(i, window).alias("block"), F.when(i < last, F.concat_ws("\n", text(i, window), F.try_element_at("kept", i + window)["norm"])).alias("longer")))
    # without a filter on their number beside it, the lines are made once
    rows = (kept.select("doc_id", F.explode(F.when(last >= 1, windows)).alias("b"))
            .select("doc_id", "b.i", "b.line_start", "b.line_end", F.xxhash64("b.block").alias("block_hash"), F.unhex(F.md5("b.block")).alias("block_md5"),
                    F.xxhash64("b.longer").alias("longer_hash"), F.unhex(F.md5("b.longer")).alias("longer_md5")))
    keys, longer = ["block_hash", "block_md5"], ["longer_hash", "longer_md5"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter(F.col("occurrences") > 1)
    # a longer window that occurs once links nothing; one that occurs more often has a repeated block
    both = rows.filter(F.col("longer_md5").isNotNull()).groupBy(*longer).agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") > 1)
    rows = rows.join(counts, keys).join(both, longer, "left")
    order = Window.partitionBy("doc_id").orderBy("i")
    linked = ((F.lag("i").over(order) == F.col("i") - 1) & (F.lag("occurrences").over(order) == F.col("occurrences"))
              & (F.lag("together").over(order) == F.col("occurrences")))
    rows = rows.withColumn("opens", (~F.coalesce(linked, F.lit(False))).cast("int"))
    rows = rows.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (rows.groupBy("doc_id", "island")
            .agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), (F.count(F.lit(1)) + window - 1).alias("n_lines"),
                 F.min_by("block_hash", "i").alias("block_hash"), F.first("occurrences").alias("occurrences"))
            .drop("island"))


def rule_py_duplicate(docs: DataFrame, window: int = DUP_WINDOW) -> DataFrame:
    from crx.operators.code.python import RULES, _fmt
    rid, sev, cat, title, desc = RULES["duplicate"]
    d = duplicate_blocks(docs, window)
    return d.select("doc_id", F.lit(rid).alias("rule_id"), F.lit(sev).alias("severity"),
                    F.lit(cat).alias("category"), "line_start", "line_end",
                    _fmt(title, F.col("n_lines")).alias("title"), F.lit(desc).alias("description"),
                    "n_lines", "block_hash", "occurrences")


def secret_line_scan(docs: DataFrame) -> DataFrame:
    """`word = "value"` assignments in free text whose name contains a secret
    word and whose stripped value is non-blank and not a placeholder."""
    def found(pattern: str):
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), 0), lambda m: F.struct(
            F.regexp_extract(m, pattern, 1).alias("name"), F.regexp_extract(m, pattern, 2).alias("value")))

    a = (text_lines(docs).select("doc_id", "line_no", F.explode(F.concat(found(ASSIGN_DQ), found(ASSIGN_SQ))).alias("m"))
         .select("doc_id", "line_no", "m.name", "m.value"))
    words = F.array(*[F.lit(w) for w in SECRET_WORDS])
    v = F.regexp_replace(F.col("value"), f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")
    hit = a.filter((v != "") & ~F.lower(v).isin(PLACEHOLDER_VALUES)
                   & F.exists(words, lambda w: F.instr(F.lower(F.col("name")), w) > 0))
    return hit.select("doc_id", "line_no", "name", F.lit("python-hardcoded-secret").alias("rule_id"),
                      F.lit("warning").alias("severity"), F.lit("security").alias("category"),
                      F.concat(F.lit("Hardcoded secret in variable '"), F.col("name"), F.lit("'")).alias("title"))
