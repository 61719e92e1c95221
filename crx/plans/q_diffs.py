"""Registered diff queries (§2.2) over the `pr_files` patches."""

from __future__ import annotations

from pyspark.sql import functions as F

import crx.sources.fixture_sql_diff  # noqa: F401  (registers the DuckDB twins)
from crx.operators import diffs as DF
from crx.plans.registry import query
from crx.sources import fixtures as X


def _diffs(spark, d):
    return DF.build_diff_text(X.pr_files(spark, d))


def _parsed(spark, d):
    return DF.parsed_diff(_diffs(spark, d))


DIFF_TEXT_SQL = """
diff_text_exp AS (
  SELECT review_id, string_agg('diff --git a/' || filename || ' b/' || filename || chr(10) || '--- a/' || filename
           || chr(10) || '+++ b/' || filename || chr(10) || patch, chr(10) ORDER BY file_seq) AS diff_text
  FROM pr_files WHERE patch IS NOT NULL AND patch <> '' GROUP BY review_id)"""


@query("build_diff_text", oracle="WITH " + DIFF_TEXT_SQL + " SELECT * FROM diff_text_exp")
def q_build_diff_text(spark, d):
    return _diffs(spark, d)


@query("diff_size_gate", oracle="WITH " + DIFF_TEXT_SQL + """
SELECT review_id, diff_text, CAST(strlen(diff_text) AS BIGINT) AS diff_bytes, strlen(diff_text) <= 500000 AS accepted
FROM diff_text_exp""")
def q_diff_size_gate(spark, d):
    return DF.diff_size_gate(_diffs(spark, d))


@query("diff_lines_raw", oracle="""
WITH parts AS (
  SELECT review_id, file_seq, 0 AS rn, 0 AS sub, 'diff --git a/' || file_path || ' b/' || file_path AS line FROM pr_hunk_exp WHERE hunk_idx = 1
  UNION ALL SELECT review_id, file_seq, 0, 1, '--- a/' || file_path FROM pr_hunk_exp WHERE hunk_idx = 1
  UNION ALL SELECT review_id, file_seq, 0, 2, '+++ b/' || file_path FROM pr_hunk_exp WHERE hunk_idx = 1
  UNION ALL SELECT review_id, file_seq, rn, 0, header FROM pr_hunk_exp
  UNION ALL SELECT review_id, file_seq, rn, 1, ' ctx ' || rn::VARCHAR FROM pr_hunk_exp
  UNION ALL SELECT review_id, file_seq, rn, 2, CASE WHEN kept_rm = 0 THEN '--- old ' ELSE '-old ' END || rn::VARCHAR FROM pr_hunk_exp
  UNION ALL SELECT review_id, file_seq, rn, 2 + j, '+new ' || rn::VARCHAR || ' ' || j::VARCHAR
            FROM (SELECT *, unnest(range(1, a + 1)) AS j FROM pr_hunk_exp)
  UNION ALL SELECT review_id, file_seq, rn, 100, '\\ No newline at end of file' FROM pr_hunk_exp WHERE nonl)
SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY file_seq, rn, sub) - 1 AS INT) AS line_no, line
FROM parts""")
def q_diff_lines_raw(spark, d):
    return DF.diff_lines_raw(_diffs(spark, d))


@query("diff_files", oracle="""
SELECT review_id, file_path, count(*) AS n_hunks FROM pr_hunk_exp GROUP BY review_id, file_path""")
def q_diff_files(spark, d):
    return (_parsed(spark, d).filter("is_hunk").groupBy("review_id", "file_path")
            .agg(F.count(F.lit(1)).alias("n_hunks")))


@query("diff_hunks", oracle="""
SELECT review_id, file_path, CAST(hunk_idx AS INT) AS hunk_idx, header, CAST(start AS BIGINT) AS old_start,
       CAST(greatest(hdr_old_count, start) AS BIGINT) AS old_count, CAST(start AS BIGINT) AS new_start,
       CAST(new_count AS BIGINT) AS new_count, CAST(1 + kept_rm + a AS BIGINT) AS n_lines
FROM pr_hunk_exp""")
def q_diff_hunks(spark, d):
    return DF.diff_hunks(None, _parsed(spark, d)).select(
        "review_id", "file_path", "hunk_idx", "header", "old_start", "old_count", "new_start", "new_count",
        "n_lines")


@query("diff_lines", oracle="""
SELECT review_id, file_path, kind, content, ref_new_line AS new_line, ref_old_line AS old_line FROM pr_line_exp""")
def q_diff_lines(spark, d):
    return DF.diff_lines(None, "ref", _parsed(spark, d)).select(
        "review_id", "file_path", "kind", "content", "new_line", "old_line")


@query("diff_line_numbers", oracle="""
SELECT review_id, file_path, kind, content, new_line, old_line FROM pr_line_exp""")
def q_diff_line_numbers(spark, d):
    return DF.diff_lines(None, "git", _parsed(spark, d)).select(
        "review_id", "file_path", "kind", "content", "new_line", "old_line")


@query("hunk_old_count", oracle="""
SELECT review_id, file_path, CAST(hunk_idx AS INT) AS hunk_idx, CAST(hdr_old_count AS BIGINT) AS hdr_old_count,
       CAST(greatest(hdr_old_count, start) AS BIGINT) AS old_count FROM pr_hunk_exp""")
def q_hunk_old_count(spark, d):
    return DF.diff_hunks(None, _parsed(spark, d)).select(
        "review_id", "file_path", "hunk_idx", "hdr_old_count", "old_count")


STATS_SQL = """
SELECT review_id, file_path, sum(a) AS added, sum(kept_rm) AS removed
FROM pr_hunk_exp GROUP BY review_id, file_path"""


@query("diff_stats", oracle=f"SELECT review_id, file_path, CAST(added AS BIGINT) AS added, "
                            f"CAST(removed AS BIGINT) AS removed FROM ({STATS_SQL})")
def q_diff_stats(spark, d):
    return DF.diff_stats(None, _parsed(spark, d))


@query("diff_totals", oracle=f"""
SELECT review_id, count(*) AS files_changed, CAST(sum(added) AS BIGINT) AS total_additions,
       CAST(sum(removed) AS BIGINT) AS total_deletions FROM ({STATS_SQL}) GROUP BY review_id""")
def q_diff_totals(spark, d):
    return DF.diff_totals(DF.diff_stats(None, _parsed(spark, d)))


@query("hunks_by_file", oracle="""
SELECT review_id, file_path, list(header ORDER BY rn) AS headers FROM pr_hunk_exp GROUP BY review_id, file_path""")
def q_hunks_by_file(spark, d):
    h = DF.hunks_by_file(DF.diff_hunks(None, _parsed(spark, d)))
    return h.select("review_id", "file_path", F.transform("hunks", lambda x: x["header"]).alias("headers"))


@query("changed_lines", oracle="""
SELECT review_id, file_path, ref_new_line AS new_line, content FROM pr_line_exp WHERE kind = '+'""")
def q_changed_lines(spark, d):
    return DF.changed_lines(DF.diff_lines(None, "ref", _parsed(spark, d))).select(
        "review_id", "file_path", "new_line", "content")


@query("diff_walk", oracle="""
SELECT review_id, file_path, kind, content, new_line, position FROM pr_line_exp WHERE kind <> '-'""")
def q_diff_walk(spark, d):
    return DF.diff_walk(None, _parsed(spark, d)).select(
        "review_id", "file_path", "kind", "content", "new_line", "position")


ANCHOR_SQL = """
anchor_exp AS (
  SELECT p.review_id, p.seq, min(l.position) AS position
  FROM anchor_probes p JOIN pr_line_exp l ON l.review_id = p.review_id AND l.file_path = p.file_path
  JOIN pr_hunk_exp h ON h.review_id = l.review_id AND h.file_path = l.file_path AND h.rn = l.rn
  WHERE l.kind <> '-' AND l.new_line BETWEEN p.line_start AND p.line_end
    AND NOT (p.line_end < h.start OR p.line_start > h.start + h.new_count - 1)
  GROUP BY p.review_id, p.seq)"""


@query("anchor_findings", oracle="WITH " + ANCHOR_SQL + """
SELECT p.review_id, p.seq, p.file_path, p.line_start, p.line_end, a.position AS diff_position
FROM anchor_probes p LEFT JOIN anchor_exp a ON a.review_id = p.review_id AND a.seq = p.seq""")
def q_anchor_findings(spark, d):
    walk = DF.diff_walk(None, _parsed(spark, d))
    return DF.anchor_findings(X.anchor_probes(spark, d), walk).select(
        "review_id", "seq", "file_path", "line_start", "line_end", "diff_position")
