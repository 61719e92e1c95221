"""Dashboard queries over the review tables (§2.10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.functions.common import count_if, round_half_even_ratio
from crx.operators.ranking import HOT_ROWS, ranked

SEVERITIES = ["critical", "warning", "suggestion"]


def active_repository_ids(records: DataFrame, prs: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories with at least one review of any status. The review side is
    reduced to distinct PR ids before the join so the shuffle carries keys only."""
    reviewed_prs = records.select(F.col("pull_request_id").alias("pr_id")).distinct()
    pr_repo = prs.select(F.col("id").alias("pr_id"), F.col("repository_id"))
    ids = reviewed_prs.join(pr_repo, "pr_id").select("repository_id").distinct()
    return ids.join(repos.select(F.col("id").alias("repository_id")), "repository_id", "left_semi")


def overview_stats(records: DataFrame, issues: DataFrame, prs: DataFrame,
                   repos: DataFrame) -> DataFrame:
    """One row: totals, severity counts, active repositories and the average.

    Written as one aggregate over a tagged union (no join of partial results)."""
    tagged = (
        records.select(F.lit("r").alias("t"), F.lit(None).cast("string").alias("sev"),
                       F.lit(None).cast("long").alias("repo"))
        .unionByName(issues.select(F.lit("i").alias("t"), F.col("severity").alias("sev"),
                                   F.lit(None).cast("long").alias("repo")))
        .unionByName(active_repository_ids(records, prs, repos).select(
            F.lit("a").alias("t"), F.lit(None).cast("string").alias("sev"),
            F.col("repository_id").alias("repo"))))
    is_issue = F.col("t") == "i"
    agg = tagged.agg(
        count_if(F.col("t") == "r").alias("total_reviews"),
        count_if(is_issue).alias("total_issues"),
        count_if(is_issue & (F.col("sev") == "critical")).alias("critical_count"),
        count_if(is_issue & (F.col("sev") == "warning")).alias("warning_count"),
        count_if(is_issue & (F.col("sev") == "suggestion")).alias("suggestion_count"),
        count_if(F.col("t") == "a").alias("active_repos"))
    return agg.select(
        "*",
        round_half_even_ratio(F.col("total_issues"), F.col("total_reviews")).alias("avg_issues_per_review"),
        F.when(F.col("total_reviews") > 0,
               F.col("total_issues") / F.col("total_reviews")).otherwise(F.lit(0.0)).alias("avg_issues_exact"))


def severity_distribution(issues: DataFrame) -> DataFrame:
    """Counts for exactly the three severities, zero-filled."""
    spark = issues.sparkSession
    counts = (issues.filter(F.col("severity").isin(SEVERITIES))
              .groupBy("severity").agg(F.count(F.lit(1)).alias("issue_count")))
    dim = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return (dim.join(counts, "severity", "left")
            .select("severity", F.coalesce("issue_count", F.lit(0)).cast("long").alias("issue_count")))


def category_distribution(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category").agg(F.count(F.lit(1)).alias("issue_count"))


def issue_trend(issues: DataFrame, days: int = 30, as_of: str = "2001-06-15 12:00:00") -> DataFrame:
    """Issues per day for `days` dates starting at the cutoff date (as_of - days);
    the cutoff day is partial and as_of's own day is not output."""
    spark = issues.sparkSession
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    first = F.to_date(cutoff)
    last = F.date_add(first, days - 1)
    counts = (issues.select("created_at")
              .filter((F.col("created_at") >= cutoff) & (F.to_date("created_at") <= last))
              .groupBy(F.to_date("created_at").alias("day"))
              .agg(F.count(F.lit(1)).alias("issue_count")))
    calendar = spark.range(1).select(F.explode(F.sequence(first, last)).alias("day"))
    return (calendar.join(counts, "day", "left")
            .select(F.date_format("day", "yyyy-MM-dd").alias("date"),
                    F.coalesce("issue_count", F.lit(0)).cast("long").alias("issue_count")))


def repo_comparison(repos: DataFrame, prs: DataFrame, records: DataFrame,
                    issues: DataFrame) -> DataFrame:
    """Per repository with >= 1 completed review: completed reviews, issues over
    all its reviews, critical issues. Issues are pre-aggregated per review."""
    per_review = issues.groupBy(F.col("review_record_id").alias("review_id")).agg(
        F.count(F.lit(1)).alias("n_issues"),
        count_if(F.col("severity") == "critical").alias("n_critical"))
    rev = records.select(F.col("id").alias("review_id"), F.col("pull_request_id").alias("pr_id"),
                         "status")
    pr_repo = prs.select(F.col("id").alias("pr_id"), "repository_id")
    per_repo = (rev.join(pr_repo, "pr_id")
                .join(per_review, "review_id", "left")
                .groupBy("repository_id")
                .agg(count_if(F.col("status") == "completed").alias("total_reviews"),
                     F.coalesce(F.sum("n_issues"), F.lit(0)).cast("long").alias("total_issues"),
                     F.coalesce(F.sum("n_critical"), F.lit(0)).cast("long").alias("critical_count"))
                .filter(F.col("total_reviews") > 0))
    return (per_repo.join(repos.select(F.col("id").alias("repository_id"),
                                       F.col("full_name").alias("repo_name")), "repository_id")
            .select("repository_id", "repo_name", "total_reviews", "total_issues", "critical_count"))


def _long(df: DataFrame, part: str, key: str | None) -> DataFrame:
    """(part, item, metric, value): a row per number of a dashboard part."""
    item = F.lit("") if key is None else F.col(key).cast("string")
    metrics = [c for c, t in df.dtypes if c != key and t not in ("string", "date")]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics])
    return df.select(F.lit(part).alias("part"), item.alias("item"), F.inline(pairs))


def dashboard_bundle(records: DataFrame, issues: DataFrame, prs: DataFrame, repos: DataFrame,
                     days: int = 30, as_of: str = "2001-06-15 12:00:00") -> DataFrame:
    """All dashboard parts in long form: (part, item, metric, value), one row per
    number. Each part is an aggregate over its own scan of the inputs."""
    parts = [_long(overview_stats(records, issues, prs, repos), "overview", None),
             _long(severity_distribution(issues), "by_severity", "severity"),
             _long(category_distribution(issues), "by_category", "category"),
             _long(issue_trend(issues, days, as_of), "trend", "date"),
             _long(repo_comparison(repos, prs, records, issues).drop("repository_id"), "repo_comparison", "repo_name")]
    return reduce(DataFrame.unionByName, parts)


def review_list(records: DataFrame, prs: DataFrame, repos: DataFrame, page: int = 1,
                status: str = "", per_page: int = 20) -> DataFrame:
    """One page of reviews, newest first (ties by id), with PR number, title cut
    to 60 characters, repository full name, and total / total_pages on each row.

    The page is a top-k (no full sort); the total is one count, a scalar subquery."""
    recs = records.filter(F.col("status") == status) if status else records
    page_rows = (recs.select("id", "pull_request_id", "status", "created_at")
                 .orderBy(F.desc("created_at"), F.desc("id"))
                 .offset((page - 1) * per_page).limit(per_page))
    total = recs.agg(F.count(F.lit(1)).alias("total")).scalar()
    pr = prs.select(F.col("id").alias("pull_request_id"), "pr_number", "title", "repository_id")
    rp = repos.select(F.col("id").alias("repository_id"), F.col("full_name").alias("repo_name"))
    return (page_rows.join(pr, "pull_request_id", "left").join(rp, "repository_id", "left")
            .withColumn("total", total)
            .select("id", "pr_number", F.substring("title", 1, 60).alias("title"), "repo_name", "status", "created_at", "total",
                    F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("long").alias("total_pages")))


def review_detail_mart(records: DataFrame, prs: DataFrame, repos: DataFrame,
                       issues: DataFrame) -> DataFrame:
    """Every review with PR number, title, repository and its issues (sorted by
    id; empty array when none). The array holds a whole review's issues; a caller
    with unbounded reviews reads `review_issues` by review instead."""
    per_review = issues.groupBy(F.col("review_record_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(
            "id", "file_path", "line_start", "line_end", "severity", "category", "rule_id",
            "title", "confidence", "source")), asc=True).alias("issues"))
    pr = prs.select(F.col("id").alias("pull_request_id"), "pr_number",
                    F.col("title").alias("pr_title"), "repository_id")
    rp = repos.select(F.col("id").alias("repository_id"), F.col("full_name").alias("repo_name"))
    return (records.join(pr, "pull_request_id", "left").join(rp, "repository_id", "left")
            .join(per_review, "id", "left")
            .select("id", "status", "summary", "pr_number", "pr_title", "repo_name",
                    "critical_count", "warning_count", "suggestion_count", "total_issues",
                    F.coalesce("issues", F.array().cast(per_review.schema["issues"].dataType)).alias("issues")))


def issues_by_file(issues: DataFrame, hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Per review and file: critical / warning / other counts, issue ids, and the
    file's display rank (critical desc, warning desc, first seen). `sizes`: the issues in
    a form that is cheaper to count by review."""
    g = issues.groupBy("review_record_id", "file_path").agg(
        count_if(F.col("severity") == "critical").alias("critical_count"),
        count_if(F.col("severity") == "warning").alias("warning_count"),
        count_if(~F.col("severity").isin("critical", "warning") | F.col("severity").isNull()).alias("suggestion_count"),
        F.sort_array(F.collect_list("id")).alias("issue_ids"),
        F.min("id").alias("first_seen"))
    order = [F.desc("critical_count"), F.desc("warning_count"), F.asc("first_seen")]
    cell = F.struct((-F.col("critical_count")).alias("critical"), (-F.col("warning_count")).alias("warning"),
                    F.shiftright(F.col("first_seen").cast("long"), 12).alias("seen"))
    return ranked(g, ["review_record_id"], order, cell, "file_rank", issues if sizes is None else sizes, hot_rows)


def issue_totals_by_review(issues: DataFrame) -> DataFrame:
    return issues.groupBy("review_record_id").agg(
        count_if(F.col("severity") == "critical").alias("total_critical"),
        count_if(F.col("severity") == "warning").alias("total_warning"),
        count_if(~F.col("severity").isin("critical", "warning") | F.col("severity").isNull()).alias("total_suggestion"))


def repositories_with_config(repos: DataFrame, configs: DataFrame, records: DataFrame,
                             prs: DataFrame) -> DataFrame:
    """All repositories with their config (if any) and their review count."""
    counts = (records.select(F.col("pull_request_id").alias("pr_id"))
              .join(prs.select(F.col("id").alias("pr_id"), "repository_id"), "pr_id")
              .groupBy("repository_id").agg(F.count(F.lit(1)).alias("review_count")))
    cfg = configs.select("repository_id", "auto_review", "enabled_categories",
                         "ignore_patterns", "ignore_rule_ids", "confidence_threshold")
    return (repos.select(F.col("id").alias("repository_id"), "full_name", "language")
            .join(cfg, "repository_id", "left")
            .join(counts, "repository_id", "left")
            .select("repository_id", "full_name", "language",
                    F.col("auto_review").isNotNull().alias("has_config"), "auto_review",
                    "enabled_categories", "ignore_patterns", "ignore_rule_ids", "confidence_threshold",
                    F.coalesce("review_count", F.lit(0)).cast("long").alias("review_count")))
