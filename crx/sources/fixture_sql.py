"""DuckDB twins of the fixture derivations, used only to build oracle SQL.

`with_fixtures(sql)` prefixes `sql` with the CTEs it mentions (and their
dependencies), so an oracle reads like a query over the review tables.
"""

from __future__ import annotations

import re

_CATS = "['security','logic','performance','best_practice','style']"

_FINDING_COLS = f"""
  'rule-' || (l_suppkey % 3)::VARCHAR AS rule_id,
  CASE WHEN l_partkey % 17 = 0 THEN 'info' WHEN l_returnflag = 'R' THEN 'critical'
       WHEN l_returnflag = 'A' THEN 'warning' ELSE 'suggestion' END AS severity,
  {_CATS}[(l_partkey % 5)::INT + 1] AS category,
  CAST(l_quantity AS INT) AS line_start,
  CAST(l_quantity AS INT) + l_linenumber AS line_end,
  'Issue rule-' || (l_suppkey % 3)::VARCHAR || ' at line ' || CAST(l_quantity AS INT)::VARCHAR AS title,
  'Item ' || l_linenumber::VARCHAR || ' of change ' || l_orderkey::VARCHAR AS description,
  CASE WHEN l_linenumber % 2 = 1 THEN 'fix ' || l_partkey::VARCHAR END AS suggestion,
  CAST(50 + 5 * CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 100 AS confidence,
  CASE WHEN l_linestatus = 'O' THEN 'ai' ELSE 'ast' END AS source"""

FIXTURE_CTES: dict[str, str] = {
    "repositories": """
  SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey + 1000 AS BIGINT) AS github_repo_id,
         lower(n_name) AS name, lower(r_name) || '/' || lower(n_name) AS full_name,
         lower(r_name) AS owner, '/repos/' || lower(r_name) || '/' || lower(n_name) AS html_url,
         'main' AS default_branch,
         CASE n_nationkey % 3 WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' END AS language,
         TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT CAST(r_regionkey + 100 AS BIGINT), CAST(r_regionkey + 2000 AS BIGINT), 'archive',
         lower(r_name) || '/archive', lower(r_name), '/repos/' || lower(r_name) || '/archive',
         'trunk', NULL, TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-01 00:00:00'
  FROM region""",
    "pull_requests": """
  SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS repository_id, o_orderkey + 1 AS pr_number,
         'Change ' || o_orderkey::VARCHAR || ': ' || o_orderpriority || ' update for ' || c_name
           || ' in ' || c_mktsegment AS title,
         CASE WHEN o_orderstatus <> 'P' THEN 'Order for customer ' || o_custkey::VARCHAR END AS body,
         'user' || o_custkey::VARCHAR AS author, o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey""",
    "review_records": """
  SELECT o_orderkey AS id, o_orderkey - o_orderkey % 2 AS pull_request_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' END AS status,
         CASE WHEN o_orderstatus <> 'O' THEN 'Reviewed change ' || o_orderkey::VARCHAR END AS summary,
         0 AS critical_count, 0 AS warning_count, 0 AS suggestion_count, 0 AS total_issues,
         'user' || o_custkey::VARCHAR AS triggered_by,
         CASE WHEN o_orderstatus = 'P' THEN 'analysis failed' END AS error_message,
         o_orderdate AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at,
         o_orderdate AS created_at
  FROM orders""",
    "lineitem_rn": """
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
         l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS rn
  FROM lineitem""",
    "review_issues": f"""
  SELECT l_orderkey * 100 + rn AS id, l_orderkey AS review_record_id,
         ['src/','tests/test_','vendor/','app/'][(l_suppkey % 4)::INT + 1] || 'mod'
           || (l_partkey % 5)::VARCHAR || ['.py','.java','.js'][(l_partkey % 3)::INT + 1] AS file_path,
         {_FINDING_COLS},
         l_shipdate AS created_at
  FROM lineitem_rn""",
    "raw_findings": f"""
  SELECT l_orderkey // 50 AS review_id, (l_orderkey // 50) % 25 AS repository_id,
         l_orderkey * 100 + rn AS seq,
         'src/mod' || (l_partkey % 3)::VARCHAR || '.py' AS file_path,
         {_FINDING_COLS}
  FROM lineitem_rn""",
    "repo_configs": f"""
  SELECT CAST(n_nationkey AS BIGINT) AS repository_id, n_nationkey % 4 <> 2 AS auto_review,
         CASE n_nationkey % 5 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['security','logic']
              WHEN 3 THEN {_CATS} WHEN 4 THEN ['style','logic','best_practice'] END AS enabled_categories,
         CASE n_nationkey % 3 WHEN 1 THEN ['vendor/'] WHEN 2 THEN ['tests/','mod1'] END AS ignore_patterns,
         CASE n_nationkey % 4 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['rule-1'] END AS ignore_rule_ids,
         'zh-CN' AS review_language, 50 AS max_files_per_review, 0.6::DOUBLE AS confidence_threshold
  FROM nation WHERE n_nationkey % 4 <> 3""",
    "users": """
  SELECT c_custkey AS github_user_id, 'user' || c_custkey::VARCHAR AS login,
         NULL::VARCHAR AS avatar_url, c_custkey % 100 = 0 AS is_admin,
         NULL::TIMESTAMP AS last_login_at, TIMESTAMP '2024-01-01 00:00:00' AS created_at
  FROM customer WHERE c_custkey % 2 = 0""",
    "login_feed": """
  SELECT user_id AS github_user_id, 'user' || user_id::VARCHAR AS login,
         '/avatars/' || user_id::VARCHAR || '/' || event_id::VARCHAR AS avatar_url,
         ts AS last_login_at, event_id AS seq
  FROM events WHERE event_type = 'signup'""",
}

# CTE dependencies (a CTE must come after what it reads).
_DEPS: dict[str, list[str]] = {
    "review_issues": ["lineitem_rn"],
    "raw_findings": ["lineitem_rn"],
}


def register(name: str, sql: str, deps: list[str] | None = None) -> None:
    FIXTURE_CTES[name] = sql
    if deps:
        _DEPS[name] = deps


def _deps(n: str) -> list[str]:
    found = [m for m in FIXTURE_CTES if m != n and re.search(rf"\b{m}\b", FIXTURE_CTES[n])]
    return list(dict.fromkeys(_DEPS.get(n, []) + found))


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _deps(n):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_fixtures(sql: str) -> str:
    """Prefix `sql` with the fixture CTEs it references."""
    used = [n for n in FIXTURE_CTES if re.search(rf"\b{n}\b", sql)]
    # CTE bodies may reference further fixtures.
    changed = True
    while changed:
        changed = False
        for n in list(used):
            for m in FIXTURE_CTES:
                if m not in used and m != n and re.search(rf"\b{m}\b", FIXTURE_CTES[n]):
                    used.append(m)
                    changed = True
    order = _closure(used)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURE_CTES[n]}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def sql_str(s: str) -> str:
    """A DuckDB string expression for the Python string `s`."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


# Python str.splitlines() in DuckDB: split on every line boundary, drop the
# empty piece after a trailing boundary.
SPLITLINES_SQL = r"""list_slice(regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), 1,
  CASE WHEN regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')[-1] = ''
       THEN len(regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) - 1
       ELSE len(regexp_split_to_array({t}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) END)"""
