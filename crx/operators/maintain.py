"""Table maintenance (§2.1): keyed upsert, cascading delete, constraint
report and settings normalisation, all as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crx.functions.text import PY_WS_CLASS

# Sensitivity names -> confidence threshold (unknown -> medium).
SENSITIVITY = {"low": 0.9, "medium": 0.7, "high": 0.6}
SENSITIVITY_DEFAULT = 0.7


def upsert_by_key(target: DataFrame, batch: DataFrame, keys: list[str], cols: list[str],
                  order_col: str = "seq", defaults: dict[str, Column] | None = None) -> DataFrame:
    """Insert new keys, overwrite `cols` of existing keys, keep the other
    columns; within the batch the last row per key (by `order_col`) wins. In an
    inserted row the other columns take `defaults` (missing: null). `BucketedTable`
    keeps a target that this join need not shuffle.

    The latest row per key is a partial aggregate (max_by), so a key repeated
    across a third of the batch still combines map-side."""
    latest = (batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_b"))
              .withColumn("_in_batch", F.lit(True)))
    t = target.withColumn("_in_target", F.lit(True))
    j = t.join(latest, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in cols:
            out.append(F.when(F.col("_in_batch"), F.col("_b")[c]).otherwise(F.col(c)).alias(c))
        else:
            fresh = F.col("_in_target").isNull()
            out.append(F.when(fresh, (defaults or {}).get(c, F.lit(None))).otherwise(F.col(c)).alias(c))
    return j.select(*out)


def cascade_delete(tables: dict[str, DataFrame], pr_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove the pull requests in `pr_ids` (column id), their reviews and the
    issues of those reviews."""
    ids = pr_ids.select(F.col("id").alias("pull_request_id")).distinct()
    prs = tables["pull_requests"].join(ids.withColumnRenamed("pull_request_id", "id"), "id", "left_anti")
    gone_reviews = tables["review_records"].join(ids, "pull_request_id", "left_semi").select(
        F.col("id").alias("review_record_id"))
    recs = tables["review_records"].join(ids, "pull_request_id", "left_anti")
    issues = tables["review_issues"].join(gone_reviews, "review_record_id", "left_anti")
    out = dict(tables)
    out.update({"pull_requests": prs, "review_records": recs, "review_issues": issues})
    return out


# Unique keys, foreign keys and required columns checked.
UNIQUE_KEYS = {"repositories": ["github_repo_id"], "repo_configs": ["repository_id"],
               "users": ["github_user_id"], "review_issues": ["id"], "review_records": ["id"],
               "pull_requests": ["id"]}
FOREIGN_KEYS = [("pull_requests", "repository_id", "repositories", "id"),
                ("review_records", "pull_request_id", "pull_requests", "id"),
                ("review_issues", "review_record_id", "review_records", "id"),
                ("repo_configs", "repository_id", "repositories", "id")]
REQUIRED = {"repositories": ["github_repo_id", "name", "full_name", "owner"],
            "pull_requests": ["repository_id", "pr_number", "title", "author"],
            "review_records": ["status"],
            "review_issues": ["review_record_id", "file_path", "line_start", "line_end", "severity", "category",
                              "title", "description"],
            "users": ["github_user_id", "login"]}


def _checked(df: DataFrame, table: str, present: set[str]) -> DataFrame:
    """What one scan of a table says to all checks: per row an entry for each unique key
    and foreign key it holds (`own`), each key that others refer to (`known`) and each
    missing column."""
    def entry(check: str, of: str, column: str, key: Column, when: Column, own: int = 1) -> Column:
        return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(of).alias("table_name"), F.lit(column).alias("column"), key.alias("key"),
                                     F.lit(own).alias("own"), F.lit(1 - own).alias("known")))

    text = lambda c: F.col(c).cast("string")
    entries = []
    if table in UNIQUE_KEYS:
        keys = UNIQUE_KEYS[table]
        entries.append(entry("unique", table, ",".join(keys), F.concat_ws(",", *map(text, keys)), F.lit(True)))
    for t, c, rt, rc in FOREIGN_KEYS:
        if table == t and rt in present:
            entries.append(entry("foreign_key", t, c, text(c), F.col(c).isNotNull()))
        if table == rt and t in present:
            entries.append(entry("foreign_key", t, c, text(rc), F.col(rc).isNotNull(), own=0))
    entries += [entry("not_null", table, c, F.lit(None).cast("string"), F.col(c).isNull()) for c in REQUIRED.get(table, [])]
    return df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, table_name, column, key, n): duplicate unique keys, orphan
    foreign keys (null references are allowed) and nulls in required columns.

    Each table is scanned once. All checks meet in one aggregate over (check, column,
    key), which combines before its shuffle: a key is a duplicate if it has several
    entries of its own, an orphan if it has some but is not known to the other table."""
    named = {t for t in tables if t in UNIQUE_KEYS or t in REQUIRED or any(t in (f[0], f[2]) for f in FOREIGN_KEYS)}
    rows = reduce(DataFrame.union, [_checked(tables[t], t, set(tables)) for t in sorted(named)])
    counts = rows.groupBy("check", "table_name", "column", "key").agg(F.sum("own").cast("long").alias("n"), F.max("known").alias("known"))
    broken = (((F.col("check") == "unique") & (F.col("n") > 1)) | ((F.col("check") == "foreign_key") & (F.col("n") > 0) & (F.col("known") == 0))
              | (F.col("check") == "not_null"))
    return counts.filter(broken).select("check", "table_name", "column", "key", "n")


def normalize_configs(settings: DataFrame) -> DataFrame:
    """Raw settings rows (repository_id, auto_review, sensitivity,
    enabled_categories, ignore_rule_ids text) -> config rows:
    auto_review == '1'; sensitivity low/medium/high -> 0.9/0.7/0.6, other ->
    0.7; ignore rule ids split on newlines, stripped, blanks dropped."""
    sens = F.coalesce(F.col("sensitivity"), F.lit("medium"))
    thr = F.lit(SENSITIVITY_DEFAULT)
    for k, v in reversed(list(SENSITIVITY.items())):
        thr = F.when(sens == k, F.lit(v)).otherwise(thr)
    strip = lambda x: F.regexp_replace(x, f"^{PY_WS_CLASS}+|{PY_WS_CLASS}+$", "")
    ids = F.filter(F.transform(F.split(F.coalesce(F.col("ignore_rule_ids"), F.lit("")), "\n", -1), strip),
                   lambda x: x != "")
    return settings.select(
        "repository_id", (F.coalesce(F.col("auto_review"), F.lit("")) == "1").alias("auto_review"),
        thr.alias("confidence_threshold"),
        F.coalesce(F.col("enabled_categories"), F.array().cast("array<string>")).alias("enabled_categories"),
        ids.alias("ignore_rule_ids"))
