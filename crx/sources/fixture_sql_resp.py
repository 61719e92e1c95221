"""DuckDB seeds for model responses: expected parse results per order."""

from crx.sources.fixture_sql import register

register("resp_orders", """
  SELECT o_orderkey AS review_id, o_orderkey % 6 AS v_p1, (o_orderkey + 2) % 6 AS v_sec, (o_orderkey + 4) % 6 AS v_logic,
         (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o_orderkey) AS n_items,
         (SELECT min(l_partkey) FROM lineitem l WHERE l.l_orderkey = o_orderkey) AS min_part
  FROM orders""")

register("resp_item_exp", """
  SELECT l_orderkey AS review_id, rn,
         CASE WHEN l_partkey % 11 <> 0 THEN 'AI-' || (l_partkey % 9)::VARCHAR ELSE 'AI-UNKNOWN' END AS rule_id,
         CASE WHEN l_linenumber = 3 THEN 'warning' WHEN l_returnflag = 'R' THEN 'critical'
              WHEN l_returnflag = 'A' THEN 'warning' ELSE 'suggestion' END AS severity,
         ['security','logic','performance','best_practice','style'][(l_partkey % 5)::INT + 1] AS category,
         'src/f' || (l_suppkey % 2)::VARCHAR || '.py' AS file_path,
         CAST(l_quantity AS BIGINT) AS line_start,
         CAST(CASE WHEN l_linenumber = 4 THEN 1 ELSE CAST(l_quantity AS INT) + l_linenumber END AS BIGINT) AS line_end,
         'Finding ' || rn::VARCHAR AS title, 'Details for part ' || l_partkey::VARCHAR AS description,
         CASE WHEN l_linenumber % 2 = 1 THEN 'use safe call ' || rn::VARCHAR ELSE '' END AS suggestion,
         CASE WHEN l_suppkey % 7 <> 0 THEN CAST(50 + 5 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 100 ELSE 0.5 END AS confidence
  FROM lineitem_rn""")
