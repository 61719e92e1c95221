"""The composed review pipeline on hand-made reviews."""

from crx.operators import diffs as DF
from crx.plans.q_review import review_pipeline

FINDING = "review_id long, seq long, rule_id string, severity string, category string, file_path string, line_start int, line_end int, title string, description string"


def test_findings_of_both_sources_keep_their_own_anchor(spark):
    patch = "@@ -1,3 +1,5 @@\n one\n+two\n+three\n four\n five"
    files = spark.createDataFrame([(1, 0, "a.py", patch), (2, 0, "big.py", "@@ -1 +1 @@\n+" + "x" * 600_000), (3, 0, "b.bin", None)],
                                  "review_id long, file_seq long, filename string, patch string")
    reviews = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "review_id long, repository_id long")
    ai = spark.createDataFrame([(1, 0, "A", "critical", "logic", "a.py", 2, 2, "t", "d", "s", 0.9, "ai"), (2, 0, "A", "critical", "logic", "big.py", 1, 1, "t", "d", "", 0.9, "ai"),
                                (1, 1, "A", "critical", "logic", "a.py", 90, 99, "t", "d", "", 0.9, "ai"), (1, 2, "A", "suggestion", "logic", "a.py", 1, 1, "t", "d", "", 0.3, "ai")],
                               FINDING + ", suggestion string, confidence double, source string")
    rules = spark.createDataFrame([(1, 0, "R", "warning", "logic", "a.py", 4, 4, "rule", "d", "snip")], FINDING + ", code_snippet string")
    configs = spark.createDataFrame([], "repository_id long, ignore_patterns array<string>, ignore_rule_ids array<string>, enabled_categories array<string>")
    out = review_pipeline(files, reviews, ai, rules, configs)
    got = {(r.review_id, r.src_rank, r.seq): r.diff_position for r in out["comments"].collect()}
    assert got == {(1, 0, 0): 3, (1, 1, 0): 5}
    rows = {r.review_id: (r.status, r.total_issues, r.critical_count, r.warning_count) for r in out["reviews"].collect()}
    assert rows == {1: ("completed", 3, 2, 1), 2: ("too_large", 1, 1, 0), 3: ("completed", 0, 0, 0)}


def test_gate_counts_the_assembled_text(spark):
    rows = [(1, 0, "f.py", "é" * 10), (1, 1, "g.py", "abc"), (1, 2, "h", None), (2, 0, "f.py", "é" * 11)]
    files = spark.createDataFrame(rows, "review_id long, file_seq long, filename string, patch string")
    size = {r.review_id: len(r.diff_text.encode()) for r in DF.build_diff_text(files).collect()}
    for limit in (size[1], size[1] - 1, size[2], size[2] - 1):
        kept = {r.review_id for r in DF.gated_diff_text(files, max_bytes=limit).collect()}
        assert kept == {k for k, n in size.items() if n <= limit}


def test_anchor_over_far_hunks_and_repeated_paths(spark):
    text = ("diff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -1,2 +1,2 @@\n x\n+y\n@@ -1999999999,1 +2000000000,2 @@\n z\n+w\n"
            "diff --git a/b b/b\n@@ -1 +1 @@\n+q\ndiff --git a/a b/a\n--- a/a\n+++ b/a\n@@ -50 +50,2 @@\n k\n+l")
    walk = DF.diff_walk(None, DF.parsed_diff(spark.createDataFrame([(1, text)], "review_id long, diff_text string")))
    f = spark.createDataFrame([(1, 1, "a", 1, 2_000_000_001), (1, 2, "a", 3, 2_000_000_000), (1, 3, "a", 51, 51), (1, 4, "a", 3, 49), (1, 5, None, 1, 1)],
                              "review_id long, seq long, file_path string, line_start int, line_end int")
    got = {r.seq: r.diff_position for r in DF.anchor_findings(f, walk).collect()}
    lines = walk.filter("file_path = 'a'").collect()
    for seq, lo, hi in ((1, 1, 2_000_000_001), (2, 3, 2_000_000_000), (3, 51, 51), (4, 3, 49)):
        want = min((r.position for r in lines if lo <= r.new_line <= hi), default=None)
        assert got[seq] == want, seq
    assert got[5] is None


def test_processed_findings_are_read_not_computed_again(spark):
    from crx.plans.registry import QUERIES, load_all
    load_all()
    plan = QUERIES["review_pipeline"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "review_findings" in plan


def test_findings_read_several_times_are_written_once(spark, monkeypatch):
    """What is behind the findings of a summary, and behind the findings that the dedup reads,
    runs once, and its shuffles don't lie on disk with those that follow."""
    from crx.operators import findings as FD
    from crx.operators import report as RP
    from crx.plans.registry import QUERIES, load_all
    load_all()
    found = spark.range(40).repartition(3).selectExpr("id % 4 AS review_id", "'critical' AS severity", "concat('f', id % 3) AS file_path", "id AS position", "'long' AS body")
    out = RP.review_summary(found, None, spark.sql("SELECT id AS review_id, 'u' AS pr_url FROM range(4)"))
    assert "RoundRobin" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r.summary_md.count("| 10 |") for r in out.orderBy("review_id").collect()] == [1] * 4
    read = []
    process = FD.process_findings
    monkeypatch.setattr(FD, "process_findings", lambda findings, configs: read.append(findings) or process(findings, configs))
    QUERIES["review_pipeline"](spark, "/root/testdata/sf0.001")
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "merged_findings" in plan
