"""Registered dashboard queries (§2.10) over the derived review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crx.operators import dashboard as D
from crx.plans.registry import query
from crx.plans.session import parts_for
from crx.sources import fixtures as X
from crx.sources.tables import read_driver_table

AS_OF = "2001-06-15 12:00:00"


def _tables(spark, d):
    return (X.review_records(spark, d), X.review_issues(spark, d),
            X.pull_requests(spark, d), X.repositories(spark, d))


@query("overview_stats", oracle="""
WITH act AS (
  SELECT count(DISTINCT p.repository_id) AS n FROM review_records r
  JOIN pull_requests p ON r.pull_request_id = p.id JOIN repositories g ON g.id = p.repository_id),
 t AS (SELECT (SELECT count(*) FROM review_records) AS total_reviews,
              (SELECT count(*) FROM review_issues) AS total_issues,
              (SELECT count(*) FROM review_issues WHERE severity = 'critical') AS critical_count,
              (SELECT count(*) FROM review_issues WHERE severity = 'warning') AS warning_count,
              (SELECT count(*) FROM review_issues WHERE severity = 'suggestion') AS suggestion_count,
              (SELECT n FROM act) AS active_repos)
SELECT *,
  CASE WHEN total_reviews = 0 THEN 0.0 ELSE
    CAST(CASE WHEN 2 * ((10 * total_issues) % total_reviews) > total_reviews THEN (10 * total_issues) // total_reviews + 1
              WHEN 2 * ((10 * total_issues) % total_reviews) < total_reviews THEN (10 * total_issues) // total_reviews
              ELSE (10 * total_issues) // total_reviews + ((10 * total_issues) // total_reviews) % 2 END AS DOUBLE) / 10 END
    AS avg_issues_per_review,
  CASE WHEN total_reviews = 0 THEN 0.0 ELSE total_issues / total_reviews END AS avg_issues_exact
FROM t""")
def q_overview_stats(spark, d):
    rec, iss, prs, repos = _tables(spark, d)
    return D.overview_stats(rec, iss, prs, repos)


@query("severity_distribution", oracle="""
SELECT s.severity, count(i.severity) AS issue_count
FROM (VALUES ('critical'), ('warning'), ('suggestion')) s(severity)
LEFT JOIN review_issues i ON i.severity = s.severity GROUP BY s.severity""")
def q_severity_distribution(spark, d):
    return D.severity_distribution(X.review_issues(spark, d))


@query("category_distribution", oracle="""
SELECT category, count(*) AS issue_count FROM review_issues GROUP BY category""")
def q_category_distribution(spark, d):
    return D.category_distribution(X.review_issues(spark, d))


@query("issue_trend", oracle=f"""
WITH cal AS (
  SELECT CAST(CAST(TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AS DATE) + CAST(i AS INTEGER) AS DATE) AS day
  FROM range(30) t(i))
SELECT strftime(cal.day, '%Y-%m-%d') AS date,
       (SELECT count(*) FROM review_issues WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY
          AND CAST(created_at AS DATE) = cal.day) AS issue_count
FROM cal""")
def q_issue_trend(spark, d):
    return D.issue_trend(X.review_issues(spark, d), 30, AS_OF)


@query("repo_comparison", oracle="""
SELECT g.id AS repository_id, g.full_name AS repo_name,
  (SELECT count(*) FROM review_records r WHERE r.status = 'completed'
     AND r.pull_request_id IN (SELECT id FROM pull_requests p WHERE p.repository_id = g.id)) AS total_reviews,
  (SELECT count(*) FROM review_issues i JOIN review_records r ON i.review_record_id = r.id
     WHERE r.pull_request_id IN (SELECT id FROM pull_requests p WHERE p.repository_id = g.id)) AS total_issues,
  (SELECT count(*) FROM review_issues i JOIN review_records r ON i.review_record_id = r.id
     WHERE i.severity = 'critical'
       AND r.pull_request_id IN (SELECT id FROM pull_requests p WHERE p.repository_id = g.id)) AS critical_count
FROM repositories g
WHERE (SELECT count(*) FROM review_records r WHERE r.status = 'completed'
     AND r.pull_request_id IN (SELECT id FROM pull_requests p WHERE p.repository_id = g.id)) > 0""")
def q_repo_comparison(spark, d):
    rec, iss, prs, repos = _tables(spark, d)
    return D.repo_comparison(repos, prs, rec, iss)


_LIST_SQL = """
WITH f AS (SELECT * FROM review_records WHERE {cond}),
 tot AS (SELECT count(*) AS total, greatest(1, (count(*) + 19) // 20) AS total_pages FROM f),
 pg AS (SELECT * FROM f ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET {offset})
SELECT pg.id, p.pr_number, substr(p.title, 1, 60) AS title, g.full_name AS repo_name, pg.status,
       pg.created_at, tot.total, tot.total_pages
FROM pg LEFT JOIN pull_requests p ON p.id = pg.pull_request_id
LEFT JOIN repositories g ON g.id = p.repository_id CROSS JOIN tot"""


@query("review_list", oracle=_LIST_SQL.format(cond="status = 'completed'", offset=40))
def q_review_list(spark, d):
    rec, _, prs, repos = _tables(spark, d)
    return D.review_list(rec, prs, repos, page=3, status="completed")


@query("review_detail_mart", oracle="""
SELECT r.id, r.status, r.summary, p.pr_number, p.title AS pr_title, g.full_name AS repo_name,
       r.critical_count, r.warning_count, r.suggestion_count, r.total_issues,
       coalesce((SELECT list(concat_ws('|', i.id, i.file_path, i.line_start, i.line_end, i.severity, i.category, i.rule_id, i.title,
                                       CAST(round(i.confidence * 100) AS INT), i.source) ORDER BY i.id)
                 FROM review_issues i WHERE i.review_record_id = r.id), []::VARCHAR[]) AS issues,
       (SELECT count(*) FROM review_issues i WHERE i.review_record_id = r.id) AS issue_count
FROM review_records r LEFT JOIN pull_requests p ON p.id = r.pull_request_id
LEFT JOIN repositories g ON g.id = p.repository_id""")
def q_review_detail_mart(spark, d):
    rec, iss, prs, repos = _tables(spark, d)
    m = D.review_detail_mart(rec, prs, repos, iss)
    return m.select("id", "status", "summary", "pr_number", "pr_title", "repo_name",
                    "critical_count", "warning_count", "suggestion_count", "total_issues",
                    F.transform("issues", lambda s: F.concat_ws(
                        "|", *[s[c].cast("string") for c in ("id", "file_path", "line_start", "line_end", "severity", "category", "rule_id", "title")],
                        F.round(s["confidence"] * 100).cast("int").cast("string"), s["source"])).alias("issues"),
                    F.size("issues").cast("long").alias("issue_count"))


@query("issues_by_file", oracle="""
WITH g AS (
  SELECT review_record_id, file_path,
         count(*) FILTER (WHERE severity = 'critical') AS critical_count,
         count(*) FILTER (WHERE severity = 'warning') AS warning_count,
         count(*) FILTER (WHERE severity IS NULL OR severity NOT IN ('critical', 'warning')) AS suggestion_count,
         min(id) AS first_seen
  FROM review_issues GROUP BY review_record_id, file_path),
k AS (SELECT *, row_number() OVER (PARTITION BY review_record_id
          ORDER BY critical_count DESC, warning_count DESC, first_seen) AS file_rank FROM g),
t AS (SELECT review_record_id, sum(critical_count)::BIGINT AS total_critical, sum(warning_count)::BIGINT AS total_warning,
             sum(suggestion_count)::BIGINT AS total_suggestion FROM g GROUP BY review_record_id)
SELECT i.review_record_id, i.file_path, k.file_rank, k.critical_count, k.warning_count, k.suggestion_count, i.id AS issue_id,
       i.line_start, i.line_end, i.severity, i.rule_id, i.title, t.total_critical, t.total_warning, t.total_suggestion
FROM review_issues i JOIN k ON k.review_record_id = i.review_record_id AND k.file_path = i.file_path
JOIN t ON t.review_record_id = i.review_record_id""")
def q_issues_by_file(spark, d):
    """The issue list of each file, with the file's rank and counts and the review's totals."""
    every = X.review_issues(spark, d)
    parts = parts_for(read_driver_table(spark, d, "lineitem"))
    issues, by_file = X.review_issues(spark, d, parts), ["review_record_id", "file_path"]
    files = D.issues_by_file(issues, sizes=every).drop("issue_ids", "first_seen").join(D.issue_totals_by_review(every), "review_record_id")
    listed = issues.select("review_record_id", "file_path", F.col("id").alias("issue_id"), "line_start", "line_end", "severity", "rule_id", "title")
    if parts:
        listed, files = listed.repartition(parts, *by_file), files.repartition(parts, *by_file)
    return (listed.join(files, by_file)
            .select("review_record_id", "file_path", "file_rank", "critical_count", "warning_count", "suggestion_count", "issue_id", "line_start",
                    "line_end", "severity", "rule_id", "title", "total_critical", "total_warning", "total_suggestion"))


@query("repositories_with_config", oracle="""
SELECT g.id AS repository_id, g.full_name, g.language, c.repository_id IS NOT NULL AS has_config,
       c.auto_review, c.enabled_categories, c.ignore_patterns, c.ignore_rule_ids, c.confidence_threshold,
       (SELECT count(*) FROM review_records r JOIN pull_requests p ON r.pull_request_id = p.id
         WHERE p.repository_id = g.id) AS review_count
FROM repositories g LEFT JOIN repo_configs c ON c.repository_id = g.id""")
def q_repositories_with_config(spark, d):
    rec, _, prs, repos = _tables(spark, d)
    return D.repositories_with_config(repos, X.repo_configs(spark, d), rec, prs)
