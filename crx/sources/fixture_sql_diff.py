"""DuckDB twins of the diff fixtures and expected parser outputs from seeds."""

from crx.sources.fixture_sql import register

register("pr_hunk_seed", """
  SELECT l_orderkey AS review_id, l_suppkey % 2 AS file_seq, 'src/f' || (l_suppkey % 2)::VARCHAR || '.py' AS file_path,
         rn, l_partkey, l_suppkey, l_linenumber, l_returnflag,
         CAST(l_quantity AS INT) % 3 + 1 AS a,
         l_partkey % 4 = 0 AS nocount,
         CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE 1 END AS kept_rm,
         l_partkey % 5 = 0 AS nonl,
         10 * rn AS start
  FROM lineitem_rn""")

register("pr_hunk_text", """
  SELECT *,
    '@@ -' || start::VARCHAR || CASE WHEN nocount THEN '' ELSE ',2' END || ' +' || start::VARCHAR
      || CASE WHEN nocount THEN '' ELSE ',' || (a + 1)::VARCHAR END || ' @@ fn_' || rn::VARCHAR AS header,
    CASE WHEN nocount THEN 1 ELSE a + 1 END AS new_count,
    CASE WHEN nocount THEN 1 ELSE 2 END AS hdr_old_count
  FROM pr_hunk_seed""")

register("pr_files", """
  SELECT review_id, file_seq, file_path AS filename, 'modified' AS status,
    CASE WHEN file_seq = 1 AND review_id % 5 = 0 THEN NULL ELSE
      string_agg(header || chr(10) || ' ctx ' || rn::VARCHAR || chr(10)
        || CASE WHEN kept_rm = 0 THEN '--- old ' ELSE '-old ' END || rn::VARCHAR || chr(10)
        || array_to_string(list_transform(range(1, a + 1), lambda j: '+new ' || rn::VARCHAR || ' ' || j::VARCHAR), chr(10))
        || CASE WHEN nonl THEN chr(10) || '\\ No newline at end of file' ELSE '' END, chr(10) ORDER BY rn) END AS patch,
    CAST(sum(a) AS INT) AS additions, CAST(count(*) AS INT) AS deletions
  FROM pr_hunk_text GROUP BY review_id, file_seq, file_path""")

# Hunks of files whose patch is present, with per-file prefix sums.
register("pr_hunk_exp", """
  SELECT h.*,
    row_number() OVER w AS hunk_idx,
    CAST(coalesce(sum(a) OVER wp, 0) AS BIGINT) AS adds_before,
    CAST(coalesce(sum(kept_rm) OVER wp, 0) AS BIGINT) AS rms_before,
    CAST(coalesce(sum(2 + kept_rm + a) OVER wp, 0) AS BIGINT) AS pos_before
  FROM pr_hunk_text h
  WHERE NOT (file_seq = 1 AND review_id % 5 = 0)
  WINDOW w AS (PARTITION BY review_id, file_seq ORDER BY rn),
         wp AS (PARTITION BY review_id, file_seq ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

# Expected body lines: kind, content, both numberings and diff position.
register("pr_line_exp", """
  SELECT review_id, file_path, rn, ' ' AS kind, 'ctx ' || rn::VARCHAR AS content,
         NULL::BIGINT AS ref_new_line, NULL::BIGINT AS ref_old_line,
         start AS new_line, start AS old_line, pos_before + 2 AS position
  FROM pr_hunk_exp
  UNION ALL
  SELECT review_id, file_path, rn, '-', 'old ' || rn::VARCHAR, NULL, start + rms_before,
         NULL, start + 1, pos_before + 3
  FROM pr_hunk_exp WHERE kept_rm = 1
  UNION ALL
  SELECT review_id, file_path, rn, '+', 'new ' || rn::VARCHAR || ' ' || j::VARCHAR,
         start + adds_before + j - 1, NULL, start + j, NULL, pos_before + 2 + kept_rm + j
  FROM (SELECT *, unnest(range(1, a + 1)) AS j FROM pr_hunk_exp)""")

register("anchor_probes", """
  SELECT l_orderkey AS review_id, l_orderkey * 100 + rn AS seq,
         'src/f' || ((l_suppkey + l_partkey) % 2)::VARCHAR || '.py' AS file_path,
         CAST((l_partkey % 13 + 1) * 10 + l_suppkey % 3 - 1 AS INT) AS line_start,
         CAST((l_partkey % 13 + 1) * 10 + l_suppkey % 3 - 1 + l_linenumber % 3 AS INT) AS line_end,
         CASE WHEN l_returnflag = 'R' THEN 'critical' WHEN l_returnflag = 'A' THEN 'warning'
              WHEN l_partkey % 17 = 0 THEN 'info' ELSE 'suggestion' END AS severity,
         'Check ' || l_partkey::VARCHAR AS title, 'Line item ' || rn::VARCHAR AS description,
         CASE WHEN l_linenumber % 2 = 0 THEN 'x = ' || rn::VARCHAR ELSE '' END AS suggestion
  FROM lineitem_rn""")
