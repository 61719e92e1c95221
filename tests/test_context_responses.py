"""Context packing, response parsing, maintenance and report edge cases."""

import json

from crx.operators import context as C
from crx.operators import maintain as M
from crx.operators import report as RP
from crx.operators import responses as R


def test_pack_files_truncates_to_exact_remainder_and_skips_missing(spark):
    files = spark.createDataFrame(
        [(1, 0, "a", "x" * 40), (1, 1, "b", None), (1, 2, "c", "y" * 40), (1, 3, "d", "z" * 8)],
        "review_id long, file_seq long, path string, content string")
    budgets = spark.createDataFrame([(1, 15)], "review_id long, files_budget long")
    got = [(r.path, r.tokens_used, r.truncated, len(r.content)) for r in
           C.pack_files(files, budgets).orderBy("file_seq").collect()]
    # a: 10 tokens; b missing (free); c: 10 > 5 left -> cut to 20 chars + mark; d: nothing left
    assert got == [("a", 10, False, 40), ("c", 5, True, 20 + len("\n... [truncated]"))]


def test_budget_split_truncates_like_int(spark):
    df = spark.createDataFrame([(1, 4000), (2, 35), (3, None), (4, 45)], "review_id long, token_budget long")
    got = {r.review_id: (r.diff_budget, r.ast_budget, r.files_budget, r.project_budget)
           for r in C.budget_split(df).collect()}
    assert got[1] == (1600, 800, 800, 400)
    assert got[2] == (int(35 * 0.4), int(35 * 0.2), int(35 * 0.2), int(35 * 0.1))
    assert got[3] == (1600, 800, 800, 400)
    assert got[4] == (int(45 * 0.4), int(45 * 0.2), int(45 * 0.2), int(45 * 0.1))


def test_truncate_summary(spark):
    entries = spark.createDataFrame([(1, 0, "k1", "a" * 30), (1, 1, "k2", "b" * 30), (2, 0, "k", "v")],
                                    "review_id long, ord long, key string, value string")
    budgets = spark.createDataFrame([(1, 5), (2, 5)], "review_id long, ast_budget long")
    got = {r.review_id: (dict(r.summary), r.tokens) for r in C.truncate_summary(entries, budgets, "ast_budget").collect()}
    text = "k1: " + "a" * 30 + "\n" + "k2: " + "b" * 30
    assert got[1] == ({"summary": text[:20] + "\n... [truncated]"}, 5)
    assert got[2] == ({"k": "v"}, 1)


def test_response_json_extraction(spark):
    texts = ["```json\n{\"summary\": \"s\", \"risk_level\": \"high\"}\n```",
             "```\nnot json\n```\n{\"summary\": \"t\"}",
             "prefix {\"findings\": [1, {\"title\": \"x\", \"confidence\": null}]} suffix",
             "[1, 2]", "{}", "no json", "{\"findings\": \"none\"}"]
    df = spark.createDataFrame([(i, "security", i, t) for i, t in enumerate(texts)],
                               "review_id long, phase string, seq long, text string")
    p1 = {r.review_id: (r.summary, r.risk_level, r.parsed) for r in R.parse_phase1(df).collect()}
    assert p1[0] == ("s", "high", True)
    assert p1[1] == ("t", "low", True)
    assert p1[3][2] is False and p1[4][2] is False and p1[5][2] is False
    assert p1[5][:2] == ("Failed to parse Phase 1 response", "medium")
    f = R.parse_findings(df).collect()
    assert [(r.review_id, r.title, r.confidence, r.rule_id, r.severity, r.line_start) for r in f] == [
        (2, "x", 0.5, "AI-UNKNOWN", "warning", 1)]


def test_select_directions(spark):
    p1 = spark.createDataFrame([(1, []), (2, ["logic", "bogus", "logic"]), (3, ["style"])],
                               "review_id long, analysis_directions array<string>")
    ov = spark.createDataFrame([(1, None), (2, []), (3, ["performance"])], "review_id long, directions array<string>")
    got = sorted((r.review_id, r.idx, r.direction) for r in R.select_directions(p1, ov).collect())
    assert got == [(1, 0, "security"), (1, 1, "logic"), (1, 2, "performance"), (1, 3, "style"),
                   (2, 0, "logic"), (2, 2, "logic"), (3, 0, "performance")]


def test_upsert_last_write_wins_and_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id long, login string, is_admin boolean")
    batch = spark.createDataFrame([(2, "b1", 1), (2, "b2", 5), (3, "c", 2)], "id long, login string, seq long")
    got = {r.id: (r.login, r.is_admin) for r in M.upsert_by_key(target, batch, ["id"], ["login"]).collect()}
    assert got == {1: ("a", True), 2: ("b2", False), 3: ("c", None)}


def test_normalize_configs(spark):
    df = spark.createDataFrame([(1, "1", "low", None, " r1 \n\n r2\n"), (2, "0", "weird", ["logic"], None)],
                               "repository_id long, auto_review string, sensitivity string, "
                               "enabled_categories array<string>, ignore_rule_ids string")
    got = {r.repository_id: (r.auto_review, r.confidence_threshold, r.enabled_categories, r.ignore_rule_ids)
           for r in M.normalize_configs(df).collect()}
    assert got == {1: (True, 0.9, [], ["r1", "r2"]), 2: (False, 0.7, ["logic"], [])}


def test_line_comment_body(spark):
    df = spark.createDataFrame(
        [(1, 1, "a.py", 3, "critical", "T", "D", "fix()"), (1, 2, "a.py", None, "warning", "T", "D", ""),
         (1, 3, "a.py", 4, "info", "T", "D", "")],
        "review_id long, seq long, file_path string, diff_position long, severity string, title string, "
        "description string, suggestion string")
    got = {r.seq: r.body for r in RP.line_comments(df).collect()}
    assert got[1] == "🔴 **Critical**: T\n\nD\n\n**建议修复**:\n```suggestion\nfix()\n```"
    assert 2 not in got
    assert got[3] == " **Info**: T\n\nD"
    assert json.dumps(got[3])


def test_cascade_delete_and_constraint_report(spark):
    prs = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 99, None)], "id long, repository_id long, title string")
    recs = spark.createDataFrame([(100, 1, "completed"), (101, 2, "pending"), (102, 7, "failed")],
                                 "id long, pull_request_id long, status string")
    issues = spark.createDataFrame([(1000, 100), (1001, 101), (1002, 101)], "id long, review_record_id long")
    t = {"pull_requests": prs, "review_records": recs, "review_issues": issues}
    out = M.cascade_delete(t, spark.createDataFrame([(2,)], "id long"))
    assert sorted(r.id for r in out["pull_requests"].collect()) == [1, 3]
    assert sorted(r.id for r in out["review_records"].collect()) == [100, 102]
    assert sorted(r.id for r in out["review_issues"].collect()) == [1000]
    repos = spark.createDataFrame([(10, 5, "n", "o/n", "o"), (11, 5, "m", "o/m", "o")],
                                  "id long, github_repo_id long, name string, full_name string, owner string")
    rep = M.constraint_report({"repositories": repos, "pull_requests": prs.withColumn("pr_number", prs.id)
                               .withColumn("author", prs.title), "review_records": recs})
    got = sorted((r.check, r.table_name, r.column, r.key, r.n) for r in rep.collect())
    assert ("unique", "repositories", "github_repo_id", "5", 2) in got
    assert ("foreign_key", "pull_requests", "repository_id", "99", 1) in got
    assert ("foreign_key", "review_records", "pull_request_id", "7", 1) in got
    assert ("not_null", "pull_requests", "title", None, 1) in got


def test_duplicate_blocks_make_the_windows_three_times_and_the_lines_once_each(spark):
    """Once for either count and once for the rows; a text too short for a window gives none."""
    import re

    from crx.operators.text_scan import duplicate_blocks
    docs = spark.createDataFrame([(1, "a\nb\n\nC\nd"), (2, "A\nb\nc\nd"), (3, "x\na\nb\nc\ny"), (4, "a\nb"), (5, None)], "doc_id long, text string")
    got = duplicate_blocks(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode", plan)) == 3 and "Filter (size" not in plan
    assert sorted((r.doc_id, r.line_start, r.line_end, r.n_lines, r.occurrences) for r in got.collect()) == [
        (1, 1, 4, 3, 3), (1, 2, 5, 3, 2), (2, 1, 3, 3, 3), (2, 2, 4, 3, 2), (3, 2, 4, 3, 3)]
