"""DuckDB seeds for the generated Python sources: expected structure and
rule hits computed from the seed columns (never by parsing the text)."""

from crx.sources.fixture_sql import register

register("py_seed", """
  SELECT l_orderkey AS file_id, 'pkg/m' || l_orderkey::VARCHAR || '.py' AS path, rn, l_partkey % 9 AS kind,
         CAST(10 * (rn - 1) + 1 AS INT) AS L, CASE l_partkey % 9 WHEN 4 THEN 4 WHEN 7 THEN 2 ELSE 1 END AS s
  FROM lineitem_rn WHERE l_orderkey % 17 <> 0""")

register("py_file_seed", """
  SELECT file_id, path, ok, T, has_long, has_branchy, T + CASE WHEN has_long THEN 56 ELSE 0 END AS B,
         T + CASE WHEN has_long THEN 56 ELSE 0 END + CASE WHEN has_branchy THEN 34 ELSE 0 END AS I,
         file_id % 3 AS extra
  FROM (SELECT l_orderkey AS file_id, 'pkg/m' || l_orderkey::VARCHAR || '.py' AS path, l_orderkey % 17 <> 0 AS ok,
               CAST(10 * count(*) + 1 AS INT) AS T, l_orderkey % 7 = 0 AS has_long, l_orderkey % 11 = 0 AS has_branchy
        FROM lineitem GROUP BY l_orderkey)""")

register("java_seed", """
  SELECT l_orderkey AS file_id, 'src/C' || l_orderkey::VARCHAR || '.java' AS path, rn, l_partkey % 7 AS kind,
         CAST(4 + 10 * (rn - 1) + 1 AS INT) AS S
  FROM lineitem_rn""")

register("java_file_seed", """
  SELECT file_id, path, T, has_long, has_branchy, has_fail,
         T + CASE WHEN has_long THEN 55 ELSE 0 END AS B,
         T + CASE WHEN has_long THEN 55 ELSE 0 END + CASE WHEN has_branchy THEN 14 ELSE 0 END AS FL
  FROM (SELECT l_orderkey AS file_id, 'src/C' || l_orderkey::VARCHAR || '.java' AS path,
               CAST(4 + 10 * count(*) + 1 AS INT) AS T, l_orderkey % 7 = 0 AS has_long,
               l_orderkey % 11 = 0 AS has_branchy, l_orderkey % 13 = 0 AS has_fail
        FROM lineitem GROUP BY l_orderkey)""")
