"""Registered context and prompt queries (§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

import crx.sources.fixture_sql_ctx  # noqa: F401
import crx.sources.fixture_sql_diff  # noqa: F401
import crx.sources.fixture_sql_resp  # noqa: F401
from crx.functions.text import estimate_tokens, truncate_text
from crx.operators import context as C
from crx.operators import diffs as DF
from crx.operators import responses as R
from crx.plans.registry import query
from crx.sources import fixtures as X
from crx.sources.fixture_sql import sql_str
from crx.sources.tables import read_driver_table

MARK = "chr(10) || '... [truncated]'"


@query("estimate_tokens", oracle="""
SELECT conv_id, turn, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM conversations""")
def q_estimate_tokens(spark, d):
    c = read_driver_table(spark, d, "conversations")
    return c.select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))


@query("truncate_text", oracle=f"""
SELECT conv_id, turn, CASE WHEN length(text) <= 200 THEN text ELSE substring(text, 1, 200) || {MARK} END AS text
FROM conversations""")
def q_truncate_text(spark, d):
    c = read_driver_table(spark, d, "conversations")
    return c.select("conv_id", "turn", truncate_text(F.col("text"), F.lit(50)).alias("text"))


@query("budget_split", oracle="""
SELECT review_id, token_budget, diff_budget, ast_budget, files_budget, project_budget FROM context_budgets""")
def q_budget_split(spark, d):
    return C.budget_split(X.context_reviews(spark, d)).select(
        "review_id", "token_budget", "diff_budget", "ast_budget", "files_budget", "project_budget")


@query("pack_files", oracle=f"""
SELECT review_id, file_seq, path, CAST(least(t, remaining) AS BIGINT) AS tokens_used, t > remaining AS truncated,
       CASE WHEN t <= remaining THEN content ELSE substring(content, 1, CAST(remaining * 4 AS INT)) || {MARK} END AS content
FROM packed_exp""")
def q_pack_files(spark, d):
    return C.pack_files(X.context_files(spark, d), C.budget_split(X.context_reviews(spark, d)))


@query("fallback_changed_files", oracle="""
WITH given AS (
  SELECT review_id, CAST(generate_subscripts(changed_files, 1) - 1 AS INT) AS idx, unnest(changed_files) AS file_path
  FROM context_reviews WHERE len(coalesce(changed_files, [])) > 0),
 fb AS (
  SELECT r.review_id, CAST(h.hunk_idx - 1 AS INT) AS idx, h.file_path
  FROM context_reviews r JOIN (SELECT review_id, file_path, row_number() OVER (PARTITION BY review_id ORDER BY file_seq) AS hunk_idx
                               FROM pr_hunk_exp WHERE hunk_idx = 1) h ON h.review_id = r.review_id
  WHERE len(coalesce(r.changed_files, [])) = 0)
SELECT * FROM given UNION ALL SELECT * FROM fb""")
def q_fallback_changed_files(spark, d):
    parsed = DF.parsed_diff(DF.build_diff_text(X.pr_files(spark, d)))
    files = parsed.filter("is_hunk").select("review_id", "file_path", "hunk_line")
    return C.fallback_changed_files(X.context_reviews(spark, d), files)


SUMMARY_SQL = """
ent AS (SELECT conv_id AS review_id, turn AS ord, '{role}_' || turn::VARCHAR AS key, text AS value
        FROM conversations WHERE role = '{role}'),
txt AS (SELECT review_id, string_agg(key || ': ' || value, chr(10) ORDER BY ord) AS text,
               map_from_entries(list(struct_pack(k := key, v := value) ORDER BY ord)) AS m
        FROM ent GROUP BY review_id)"""


@query("truncate_summary", oracle="WITH " + SUMMARY_SQL.format(role="user") + f"""
SELECT t.review_id,
  CASE WHEN greatest(1, length(t.text) // 4) > b.ast_budget
       THEN MAP {{'summary': substring(t.text, 1, CAST(b.ast_budget * 4 AS INT)) || {MARK}}} ELSE t.m END AS summary,
  CAST(least(greatest(1, length(t.text) // 4), b.ast_budget) AS BIGINT) AS tokens
FROM txt t JOIN context_budgets b ON b.review_id = t.review_id""")
def q_truncate_summary(spark, d):
    return C.truncate_summary(X.summary_entries(spark, d, "user"),
                              C.budget_split(X.context_reviews(spark, d)), "ast_budget")


@query("context_usage", oracle="""
WITH dt AS (
  SELECT review_id, string_agg('diff --git a/' || filename || ' b/' || filename || chr(10) || '--- a/' || filename
           || chr(10) || '+++ b/' || filename || chr(10) || patch, chr(10) ORDER BY file_seq) AS diff_text
  FROM pr_files WHERE patch IS NOT NULL AND patch <> '' GROUP BY review_id),
 ua AS (SELECT conv_id AS review_id, string_agg('user_' || turn::VARCHAR || ': ' || text, chr(10) ORDER BY turn) AS t
        FROM conversations WHERE role = 'user' GROUP BY conv_id),
 pa AS (SELECT conv_id AS review_id, string_agg('assistant_' || turn::VARCHAR || ': ' || text, chr(10) ORDER BY turn) AS t
        FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
 fu AS (SELECT review_id, sum(least(t, remaining)) AS used FROM packed_exp GROUP BY review_id)
SELECT b.review_id, b.token_budget, b.diff_budget, b.ast_budget, b.files_budget, b.project_budget,
  CAST(least(greatest(1, coalesce(length(dt.diff_text), 0) // 4), b.diff_budget)
     + least(greatest(1, coalesce(length(ua.t), 0) // 4), b.ast_budget)
     + coalesce(fu.used, 0)
     + least(greatest(1, coalesce(length(pa.t), 0) // 4), b.project_budget) AS BIGINT) AS token_used
FROM context_budgets b LEFT JOIN dt ON dt.review_id = b.review_id LEFT JOIN ua ON ua.review_id = b.review_id
LEFT JOIN pa ON pa.review_id = b.review_id LEFT JOIN fu ON fu.review_id = b.review_id""")
def q_context_usage(spark, d):
    reviews = X.context_reviews(spark, d)
    packed = C.pack_files(X.context_files(spark, d), C.budget_split(reviews))
    return C.context_usage(reviews, DF.build_diff_text(X.pr_files(spark, d)), packed,
                           X.summary_entries(spark, d, "user"), X.summary_entries(spark, d, "assistant"))


@query("classify_repo_files", oracle="""
SELECT repository_id, file_id, path, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth,
       len(string_split(path, '/')) - 1 <= 5 AS listed,
       CASE WHEN is_dir THEN path || '/' ELSE path END AS tree_path,
       NOT is_dir AND len(list_filter(['.github/workflows/', '.github/dependabot.yml', 'setup.cfg', 'pyproject.toml',
            'pom.xml', 'build.gradle', 'package.json', 'go.mod', 'Cargo.toml', 'Makefile'],
            lambda c: starts_with(path, c))) > 0 AS is_config,
       NOT is_dir AND len(list_filter(['requirements.txt', 'Pipfile', 'Pipfile.lock', 'pom.xml', 'build.gradle',
            'package.json', 'package-lock.json', 'go.mod', 'go.sum', 'Cargo.toml', 'Cargo.lock'],
            lambda c: contains(path, c))) > 0 AS is_dependency
FROM repo_files""")
def q_classify_repo_files(spark, d):
    return C.classify_repo_files(X.repo_files(spark, d)).select(
        "repository_id", "file_id", "path", "depth", "listed", "tree_path", "is_config", "is_dependency")


@query("repo_structure", oracle="""
WITH c AS (
  SELECT *, len(string_split(path, '/')) - 1 AS depth,
    NOT is_dir AND len(list_filter(['.github/workflows/', '.github/dependabot.yml', 'setup.cfg', 'pyproject.toml',
            'pom.xml', 'build.gradle', 'package.json', 'go.mod', 'Cargo.toml', 'Makefile'],
            lambda c: starts_with(path, c))) > 0 AS is_config,
    NOT is_dir AND len(list_filter(['requirements.txt', 'Pipfile', 'Pipfile.lock', 'pom.xml', 'build.gradle',
            'package.json', 'package-lock.json', 'go.mod', 'go.sum', 'Cargo.toml', 'Cargo.lock'],
            lambda c: contains(path, c))) > 0 AS is_dependency
  FROM repo_files)
SELECT repository_id, 'tree' AS kind, CASE WHEN is_dir THEN path || '/' ELSE path END AS path, NULL::VARCHAR AS content FROM c WHERE depth <= 5
UNION ALL SELECT repository_id, 'config', path, content FROM c WHERE depth <= 5 AND is_config
UNION ALL SELECT repository_id, 'dependency', path, content FROM c WHERE depth <= 5 AND is_dependency""")
def q_repo_structure(spark, d):
    return C.repo_structure(X.repo_files(spark, d))



def _stage1_inputs(spark, d):
    prs = X.pull_requests(spark, d).select(F.col("id").alias("review_id"), "title",
                                           F.col("body").alias("description"))
    pf = X.pr_files(spark, d)
    changed = pf.select("review_id", F.col("file_seq").cast("int").alias("idx"), F.col("filename").alias("file_path"))
    diffs = DF.build_diff_text(pf)
    totals = DF.diff_totals(DF.diff_stats(diffs))
    return prs, changed, totals, diffs


@query("stage1_prompts", oracle=f"""
WITH dt AS (
  SELECT review_id, string_agg('diff --git a/' || filename || ' b/' || filename || chr(10) || '--- a/' || filename
           || chr(10) || '+++ b/' || filename || chr(10) || patch, chr(10) ORDER BY file_seq) AS diff_text
  FROM pr_files WHERE patch IS NOT NULL AND patch <> '' GROUP BY review_id),
 fl AS (SELECT review_id, string_agg('- `' || filename || '`', chr(10) ORDER BY file_seq) AS files FROM pr_files GROUP BY review_id),
 st AS (SELECT review_id, count(DISTINCT file_path) AS n, sum(a) AS ad, sum(kept_rm) AS rm FROM pr_hunk_exp GROUP BY review_id)
SELECT p.id AS review_id, {sql_str(C.SYSTEM_PROMPT)} AS system_prompt,
  {sql_str(C.STAGE1_HEAD)} || '- Title: ' || coalesce(p.title, '') || chr(10) || '- Description: ' || coalesce(p.body, '')
  || chr(10) || chr(10) || '### Changed files' || chr(10) || coalesce(fl.files, '')
  || chr(10) || chr(10) || '### Totals' || chr(10) || '- Files changed: ' || coalesce(st.n, 0)::VARCHAR
  || chr(10) || '- Additions: ' || coalesce(st.ad, 0)::VARCHAR || chr(10) || '- Deletions: ' || coalesce(st.rm, 0)::VARCHAR
  || chr(10) || chr(10) || '### Diff (first 3000 characters)' || chr(10) || '```' || chr(10)
  || substring(coalesce(dt.diff_text, ''), 1, 3000) || chr(10) || '```' || {sql_str(C.STAGE1_TAIL)} AS user_prompt
FROM pull_requests p LEFT JOIN fl ON fl.review_id = p.id LEFT JOIN st ON st.review_id = p.id
LEFT JOIN dt ON dt.review_id = p.id""")
def q_stage1_prompts(spark, d):
    return C.stage1_prompts(*_stage1_inputs(spark, d))


_FOCUS = "CASE direction " + " ".join(f"WHEN '{k}' THEN {sql_str(v)}" for k, v in C.DIRECTION_FOCUS.items()) + " END"


@query("stage2_prompts", oracle=f"""
WITH p1 AS (
  SELECT review_id,
    CASE WHEN v_p1 IN (0, 1, 2, 5) THEN 'Change ' || review_id::VARCHAR || ' has ' || coalesce(n_items, 0)::VARCHAR || ' items'
         ELSE 'Failed to parse Phase 1 response' END AS summary,
    CASE WHEN v_p1 IN (0, 1, 2, 5) THEN CASE WHEN review_id % 7 = 0 THEN 'low' ELSE ['low','medium','high'][(review_id % 3)::INT + 1] END
         ELSE 'medium' END AS risk_level,
    CASE WHEN v_p1 IN (0, 1, 2, 5) THEN CASE review_id % 5 WHEN 1 THEN ['security'] WHEN 2 THEN ['logic','style']
         WHEN 3 THEN ['security','bogus','security'] ELSE []::VARCHAR[] END ELSE []::VARCHAR[] END AS p1,
    CASE review_id % 4 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['style'] WHEN 3 THEN ['logic','security'] END AS ov
  FROM resp_orders),
 ch AS (SELECT review_id, CASE WHEN len(coalesce(ov, [])) > 0 THEN ov WHEN len(p1) > 0 THEN p1
            ELSE ['security','logic','performance','style'] END AS ch FROM p1),
 dirs AS (SELECT * FROM (SELECT review_id, CAST(generate_subscripts(ch, 1) - 1 AS INT) AS idx, unnest(ch) AS direction FROM ch)
          WHERE direction IN ('security','logic','performance','style')),
 files AS (SELECT review_id, string_agg('#### `' || path || '`' || chr(10) || '```' || chr(10)
             || CASE WHEN t <= remaining THEN content ELSE substring(content, 1, CAST(remaining * 4 AS INT)) || {MARK} END
             || chr(10) || '```', chr(10) || chr(10) ORDER BY file_seq) AS files_text FROM packed_exp GROUP BY review_id),
 rules AS (SELECT review_record_id AS review_id, string_agg('- [' || upper(severity) || '] ' || rule_id || ': ' || title
             || ' (' || file_path || ':' || line_start::VARCHAR || ')', chr(10)
             ORDER BY file_path, line_start, rule_id, severity, title) AS rules_text
           FROM review_issues WHERE source = 'ast' GROUP BY review_record_id)
SELECT d.review_id, d.idx, d.direction, {sql_str(C.SYSTEM_PROMPT)} AS system_prompt,
  '## Phase 2: ' || d.direction || ' review' || chr(10) || chr(10) || 'Look for ' || {_FOCUS} || '.' || chr(10) || chr(10)
  || '### Context' || chr(10) || '- Title: ' || coalesce(pr.title, '') || chr(10) || '- Phase 1 summary: ' || coalesce(p1.summary, '')
  || CASE WHEN d.direction = 'security' THEN chr(10) || '- Risk level: ' || coalesce(p1.risk_level, 'low') || chr(10) || chr(10)
       || '### Rule findings' || chr(10) || coalesce(rules.rules_text, 'No rule findings.') ELSE '' END
  || CASE WHEN d.direction IN ('logic', 'style') THEN chr(10) || chr(10) || '### Functions' || chr(10) || 'None.' ELSE '' END
  || chr(10) || chr(10) || '### Files' || chr(10) || coalesce(files.files_text, '') || {sql_str(C.FINDINGS_TAIL)} AS user_prompt
FROM dirs d LEFT JOIN pull_requests pr ON pr.id = d.review_id LEFT JOIN p1 ON p1.review_id = d.review_id
LEFT JOIN files ON files.review_id = d.review_id LEFT JOIN rules ON rules.review_id = d.review_id""")
def q_stage2_prompts(spark, d):
    responses = X.model_responses(spark, d)
    p1 = R.parse_phase1(responses.filter(F.col("phase") == "phase1"))
    dirs = R.select_directions(p1, X.direction_overrides(spark, d))
    reviews = X.pull_requests(spark, d).select(F.col("id").alias("review_id"), "title")
    packed = C.pack_files(X.context_files(spark, d), C.budget_split(X.context_reviews(spark, d)))
    rules = (X.review_issues(spark, d).filter(F.col("source") == "ast")
             .withColumnRenamed("review_record_id", "review_id"))
    return C.stage2_prompts(reviews, dirs, p1, packed, rules, None)
