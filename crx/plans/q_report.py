"""Registered report, bundle and extension queries (§2.10-2.13)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

import crx.sources.fixture_sql_diff  # noqa: F401
import crx.sources.fixture_sql_resp  # noqa: F401
from crx.operators import context as C
from crx.operators import dashboard as D
from crx.operators import diffs as DF
from crx.operators import findings as FD
from crx.operators import report as RP
from crx.operators import responses as R
from crx.operators.scoring import score_with
from crx.plans.q_diffs import ANCHOR_SQL
from crx.plans.q_findings import PROCESS_SQL, findings_read
import crx.plans.q_dashboard  # noqa: F401  (the parts' queries)
from crx.plans.q_context import _stage1_inputs
from crx.plans.registry import ORACLES, query
from crx.sources import fixtures as X
from crx.sources.fixture_sql import sql_str

_HEAD = """CASE severity WHEN 'critical' THEN '🔴' WHEN 'warning' THEN '🟠' WHEN 'suggestion' THEN '⚪' ELSE '' END
  || ' **' || CASE severity WHEN 'critical' THEN 'Critical' WHEN 'warning' THEN 'Warning' WHEN 'suggestion' THEN 'Suggestion'
  ELSE upper(substring(severity, 1, 1)) || lower(substring(severity, 2)) END || '**'"""


@query("line_comments", oracle="WITH " + ANCHOR_SQL + f"""
SELECT p.review_id, p.seq, p.file_path AS path, a.position AS diff_position,
  {_HEAD.replace('severity', 'p.severity')} || ': ' || p.title || chr(10) || chr(10) || p.description
  || CASE WHEN p.suggestion <> '' THEN chr(10) || chr(10) || '**建议修复**:' || chr(10) || '```suggestion' || chr(10)
          || p.suggestion || chr(10) || '```' ELSE '' END AS body
FROM anchor_probes p JOIN anchor_exp a ON a.review_id = p.review_id AND a.seq = p.seq""")
def q_line_comments(spark, d):
    walk = DF.diff_walk(None, DF.parsed_diff(DF.build_diff_text(X.pr_files(spark, d))))
    return RP.line_comments(DF.anchor_findings(X.anchor_probes(spark, d), walk))


def _processed(spark, d):
    return FD.process_findings(findings_read(spark, d), X.repo_configs(spark, d))


@query("high_risk_files", oracle=PROCESS_SQL + """
SELECT review_id, file_path, count(*) AS n_findings, min(position) AS first_seen,
       row_number() OVER (PARTITION BY review_id ORDER BY count(*) DESC, min(position)) AS rank
FROM processed GROUP BY review_id, file_path""")
def q_high_risk_files(spark, d):
    return RP.high_risk_files(_processed(spark, d), sizes=X.raw_findings(spark, d))


_P1 = """CASE WHEN v_p1 IN (0, 1, 2, 5) THEN 'Change ' || review_id::VARCHAR || ' has ' || coalesce(n_items, 0)::VARCHAR
  || ' items' ELSE 'Failed to parse Phase 1 response' END"""


@query("review_summary", oracle=PROCESS_SQL + f""",
sev AS (SELECT review_id, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'warning') AS w,
               count(*) FILTER (WHERE severity = 'suggestion') AS s FROM processed GROUP BY review_id),
hr AS (SELECT review_id, file_path, count(*) AS n, row_number() OVER (PARTITION BY review_id ORDER BY count(*) DESC, min(position)) AS rk
       FROM processed GROUP BY review_id, file_path),
risk AS (SELECT review_id, string_agg('- `' || file_path || '` (' || n::VARCHAR || ' 个问题)', chr(10) ORDER BY rk) AS t
         FROM hr GROUP BY review_id),
rv AS (SELECT DISTINCT review_id FROM raw_findings)
SELECT rv.review_id,
  '## 🤖 AI Review 总结' || chr(10) || chr(10)
  || coalesce(CASE WHEN p.review_id IS NOT NULL THEN {_P1.replace('review_id', 'p.review_id').replace('v_p1', 'p.v_p1').replace('n_items', 'p.n_items')} || chr(10) || chr(10) END, '')
  || '### 问题统计' || chr(10) || '| 级别 | 数量 |' || chr(10) || '|------|------|' || chr(10)
  || '| 🔴 Critical | ' || coalesce(sev.c, 0)::VARCHAR || ' |' || chr(10)
  || '| 🟠 Warning | ' || coalesce(sev.w, 0)::VARCHAR || ' |' || chr(10)
  || '| ⚪ Suggestion | ' || coalesce(sev.s, 0)::VARCHAR || ' |'
  || coalesce(chr(10) || chr(10) || '### 高风险文件' || chr(10) || risk.t, '')
  || chr(10) || chr(10) || '---' || chr(10) || '> 查看完整分析报告: [Dashboard](/reviews/' || rv.review_id::VARCHAR || ')' AS summary_md
FROM rv LEFT JOIN sev ON sev.review_id = rv.review_id LEFT JOIN risk ON risk.review_id = rv.review_id
LEFT JOIN resp_orders p ON p.review_id = rv.review_id""")
def q_review_summary(spark, d):
    found = _processed(spark, d)
    p1 = R.parse_phase1(X.model_responses(spark, d).filter(F.col("phase") == "phase1"))
    reviews = X.raw_findings(spark, d).select("review_id").distinct().withColumn(
        "pr_url", F.concat(F.lit("/reviews/"), F.col("review_id").cast("string")))
    return RP.review_summary(found, p1, reviews)


@query("review_notices", oracle=f"""
SELECT id AS review_id, 'model_error' AS notice_kind, {sql_str(RP.MODEL_ERROR_NOTICE)} AS notice
FROM review_records WHERE status = 'failed'""")
def q_review_notices(spark, d):
    gate = DF.diff_size_gate(DF.build_diff_text(X.pr_files(spark, d))).select("review_id", "accepted")
    recs = X.review_records(spark, d).select(F.col("id").alias("review_id"), "status")
    return RP.review_notices(recs.join(gate, "review_id", "left"))


def _long_sql(part: str, key: str, query_key: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {key} AS item, '{m}' AS metric, {m}::DOUBLE AS value FROM ({ORACLES[query_key]})"
                              for m in metrics)


@query("dashboard_bundle", oracle=" UNION ALL ".join([
    _long_sql("overview", "''", "overview_stats", ["total_reviews", "total_issues", "critical_count", "warning_count", "suggestion_count",
                                                   "active_repos", "avg_issues_per_review", "avg_issues_exact"]),
    _long_sql("by_severity", "severity", "severity_distribution", ["issue_count"]),
    _long_sql("by_category", "category", "category_distribution", ["issue_count"]),
    _long_sql("trend", "date", "issue_trend", ["issue_count"]),
    _long_sql("repo_comparison", "repo_name", "repo_comparison", ["total_reviews", "total_issues", "critical_count"])]))
def q_dashboard_bundle(spark, d):
    return D.dashboard_bundle(X.review_records(spark, d), X.review_issues(spark, d), X.pull_requests(spark, d), X.repositories(spark, d))


def stub_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model client: answers with the prompt's
    token estimate and fails for every tenth review."""
    if any(r % 10 == 7 for r in pdf["review_id"]):
        raise ValueError("model unavailable")
    # plain lists: a batch with a failing row is scored row by row, where column operations cost most
    n = [len(p) // 4 for p in pdf["user_prompt"]]
    return pd.DataFrame({"content": [f'{{"summary": "tokens={k}"}}' for k in n], "model": "stub", "total_tokens": n, "finish_reason": "stop"})


@query("score_with", oracle=f"""
SELECT review_id, 'phase1' AS phase,
  CASE WHEN review_id % 10 <> 7 THEN '{{"summary": "tokens=' || (length(user_prompt) // 4)::VARCHAR || '"}}' END AS content,
  CASE WHEN review_id % 10 <> 7 THEN 'stub' END AS model,
  CASE WHEN review_id % 10 <> 7 THEN (length(user_prompt) // 4)::BIGINT ELSE 0 END AS total_tokens,
  CASE WHEN review_id % 10 <> 7 THEN 'stop' ELSE 'error' END AS finish_reason,
  CASE WHEN review_id % 10 = 7 THEN 'ValueError: model unavailable' END AS error
FROM ({ORACLES["stage1_prompts"]})""")
def q_score_with(spark, d):
    prompts = C.stage1_prompts(*_stage1_inputs(spark, d))
    return score_with(prompts.withColumn("phase", F.lit("phase1")), stub_scorer)
