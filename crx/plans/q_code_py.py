"""Registered Python code-structure and rule queries (§2.3, §2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

import crx.sources.fixture_sql_code  # noqa: F401
from crx.operators.code import nodes as N
from crx.operators.code import python as P
from crx.operators.code import dispatch as DS
from crx.plans.registry import query
from crx.sources import fixtures as X


def _scan(spark, d):
    """The node table of the Python files of the generated corpus, parsed once
    per session and shared with the dispatch queries."""
    return DS.language_table(X.mixed_sources(spark, d), "python")


def _nodes(spark, d):
    return N.code_nodes(scan=_scan(spark, d))


RULE_SQL = """
SELECT file_id, path AS file_path, '{rid}' AS rule_id, '{sev}' AS severity, '{cat}' AS category,
       {ls} AS line_start, {le} AS line_end, {title} AS title
FROM {src} WHERE {cond}"""


def _rule_oracle(key, ls="L + 2", le="L + 2", title=None, cond="TRUE", src="py_seed"):
    rid, sev, cat, t, _ = P.RULES[key]
    return RULE_SQL.format(rid=rid, sev=sev, cat=cat, ls=ls, le=le, title=title or f"'{t}'", src=src, cond=cond)


def _rule_q(fn):
    def q(spark, d):
        return fn(_nodes(spark, d)).select("file_id", "file_path", "rule_id", "severity", "category",
                                           "line_start", "line_end", "title")
    return q


query("rule_py_exec_eval", oracle=_rule_oracle("exec_eval", title="'Detected eval() call'", cond="kind = 0"))(
    _rule_q(P.rule_py_exec_eval))
query("rule_py_unsafe_pickle", oracle=_rule_oracle(
    "unsafe_pickle", title="'Unsafe deserialization via pickle.loads()'", cond="kind = 1"))(_rule_q(P.rule_py_unsafe_pickle))
query("rule_py_shell_injection", oracle=_rule_oracle(
    "shell_injection", title="'Potential shell injection via subprocess.run()'", cond="kind = 2"))(
    _rule_q(P.rule_py_shell_injection))
query("rule_py_sql_concat", oracle=_rule_oracle(
    "sql_concat", title="'SQL string concatenation in cursor.execute()'", cond="kind = 3"))(_rule_q(P.rule_py_sql_concat))
query("rule_py_bare_except", oracle=_rule_oracle("bare_except", ls="L + 4", le="L + 5", cond="kind = 4"))(
    _rule_q(P.rule_py_bare_except))
query("rule_py_hardcoded_secret", oracle=_rule_oracle(
    "hardcoded_secret", title="'Hardcoded secret in variable ''password'''", cond="kind = 5"))(
    _rule_q(P.rule_py_hardcoded_secret))
query("rule_py_file_leak", oracle=_rule_oracle("file_leak", cond="kind = 6"))(_rule_q(P.rule_py_file_leak))
query("rule_py_complexity", oracle=_rule_oracle(
    "complexity", ls="B", le="B + 33", title="'Function ''branchy'' has high cyclomatic complexity (17)'",
    cond="ok AND has_branchy", src="py_file_seed"))(_rule_q(P.rule_py_complexity))
query("rule_py_function_length", oracle=_rule_oracle(
    "function_length", ls="T", le="T + 55", title="'Function ''long_' || file_id::VARCHAR || ''' is too long (56 lines)'",
    cond="ok AND has_long", src="py_file_seed"))(_rule_q(P.rule_py_function_length))


@query("parse_status", oracle="""
SELECT file_id, path, ok AS success,
       CAST(I + 3 + CASE extra WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END + CASE WHEN ok THEN 0 ELSE 1 END - 1 AS INT) AS lines_of_code
FROM py_file_seed""")
def q_parse_status(spark, d):
    return N.parse_status(scan=_scan(spark, d)).select("file_id", "path", "success", "lines_of_code")


@query("code_nodes", oracle="""
SELECT file_id, count(*) FILTER (WHERE true) AS n_functions FROM (
  SELECT file_id FROM py_seed
  UNION ALL SELECT file_id FROM py_file_seed WHERE ok AND has_long
  UNION ALL SELECT file_id FROM py_file_seed WHERE ok AND has_branchy
  UNION ALL SELECT file_id FROM py_file_seed WHERE ok AND extra = 1) GROUP BY file_id""")
def q_code_nodes(spark, d):
    n = _nodes(spark, d)
    return (n.filter(F.col("kind").isin("FunctionDef", "AsyncFunctionDef"))
            .groupBy("file_id").agg(F.count(F.lit(1)).alias("n_functions")))


@query("py_imports", oracle="""
SELECT file_id, path, I AS line_start, 'os' AS import_name FROM py_file_seed WHERE ok
UNION ALL SELECT file_id, path, I + 1, '.sibling' FROM py_file_seed WHERE ok
UNION ALL SELECT file_id, path, I + 2, 'pkg.sub.thing' FROM py_file_seed WHERE ok""")
def q_py_imports(spark, d):
    return P.py_imports(_nodes(spark, d)).select("file_id", "path", "line_start", "import_name")


@query("py_functions", oracle="""
SELECT file_id, path, 'f_' || rn::VARCHAR AS name, L AS line_start, L + 2 + s AS line_end, ['a', 'b'] AS args,
       NULL::VARCHAR AS returns, []::VARCHAR[] AS decorators, CASE WHEN kind = 4 THEN 2 ELSE 1 END AS complexity,
       false AS is_async FROM py_seed
UNION ALL SELECT file_id, path, 'long_' || file_id::VARCHAR, T, T + 55, ['v'], NULL, []::VARCHAR[], 1, false
  FROM py_file_seed WHERE ok AND has_long
UNION ALL SELECT file_id, path, 'branchy', B, B + 33, ['v'], NULL, []::VARCHAR[], 17, false
  FROM py_file_seed WHERE ok AND has_branchy
UNION ALL SELECT file_id, path, 'fetch_' || file_id::VARCHAR, I + 3, I + 4, ['u'], NULL, []::VARCHAR[], 1, true
  FROM py_file_seed WHERE ok AND extra = 1""")
def q_py_functions(spark, d):
    return P.py_functions(_nodes(spark, d)).select(
        "file_id", "path", "name", "line_start", "line_end", "args", "returns", "decorators", "complexity", "is_async")


@query("py_complexity", oracle="""
SELECT file_id, 'f_' || rn::VARCHAR AS name, CASE WHEN kind = 4 THEN 2 ELSE 1 END AS complexity FROM py_seed
UNION ALL SELECT file_id, 'long_' || file_id::VARCHAR, 1 FROM py_file_seed WHERE ok AND has_long
UNION ALL SELECT file_id, 'branchy', 17 FROM py_file_seed WHERE ok AND has_branchy
UNION ALL SELECT file_id, 'fetch_' || file_id::VARCHAR, 1 FROM py_file_seed WHERE ok AND extra = 1""")
def q_py_complexity(spark, d):
    return P.py_complexity(_nodes(spark, d)).select("file_id", "name", "complexity")


@query("py_classes", oracle="""
SELECT file_id, path, 'Model_' || file_id::VARCHAR AS name, I + 4 AS line_start, I + 5 AS line_end,
       ['Base', 'mixins.Audit'] AS bases, ['@dataclass'] AS decorators, []::VARCHAR[] AS methods
FROM py_file_seed WHERE ok AND extra = 0""")
def q_py_classes(spark, d):
    return P.py_classes(_nodes(spark, d)).select("file_id", "path", "name", "line_start", "line_end", "bases",
                                                 "decorators", "methods")


@query("py_calls", oracle="""
SELECT file_id, path, callee, line, args, keyword_args FROM (
  SELECT file_id, path, 'eval' AS callee, L + 2 AS line, ['a'] AS args, []::VARCHAR[] AS keyword_args FROM py_seed WHERE kind = 0
  UNION ALL SELECT file_id, path, 'pickle.loads', L + 2, ['b'], []::VARCHAR[] FROM py_seed WHERE kind = 1
  UNION ALL SELECT file_id, path, 'subprocess.run', L + 2, ['a'], ['shell'] FROM py_seed WHERE kind = 2
  UNION ALL SELECT file_id, path, 'cursor.execute', L + 2, ['''SELECT * FROM t WHERE id = '' + a'], []::VARCHAR[] FROM py_seed WHERE kind = 3
  UNION ALL SELECT file_id, path, 'int', L + 3, ['a'], []::VARCHAR[] FROM py_seed WHERE kind = 4
  UNION ALL SELECT file_id, path, 'open', L + 2, ['a'], []::VARCHAR[] FROM py_seed WHERE kind IN (6, 7)
  UNION ALL SELECT file_id, path, 'fh.read', L + 3, []::VARCHAR[], []::VARCHAR[] FROM py_seed WHERE kind = 7
  UNION ALL SELECT file_id, path, 'get', I + 4, ['u'], []::VARCHAR[] FROM py_file_seed WHERE ok AND extra = 1)""")
def q_py_calls(spark, d):
    return P.py_calls(_nodes(spark, d)).select("file_id", "path", "callee", "line", "args", "keyword_args")


@query("py_assignments", oracle="""
SELECT file_id, path, line_start, target FROM (
  SELECT file_id, path, L + 1 AS line_start, 'x' AS target FROM py_seed
  UNION ALL SELECT file_id, path, L + 2, 'data' FROM py_seed WHERE kind = 1
  UNION ALL SELECT file_id, path, L + 3, 'x' FROM py_seed WHERE kind IN (4, 7)
  UNION ALL SELECT file_id, path, L + 2, 'password' FROM py_seed WHERE kind = 5
  UNION ALL SELECT file_id, path, L + 2, 'fh' FROM py_seed WHERE kind = 6
  UNION ALL SELECT file_id, path, L + 2, 'api_token' FROM py_seed WHERE kind = 8
  UNION ALL SELECT file_id, path, T + CAST(r.i AS INT), 'v' FROM py_file_seed, range(1, 55) r(i) WHERE ok AND has_long
  UNION ALL SELECT file_id, path, B + 2 * CAST(r.i AS INT), 'v' FROM py_file_seed, range(1, 17) r(i) WHERE ok AND has_branchy)""")
def q_py_assignments(spark, d):
    return P.py_assignments(_nodes(spark, d)).select("file_id", "path", "line_start", "target")


@query("py_exception_blocks", oracle="""
SELECT file_id, path, L + 4 AS line_start, L + 5 AS line_end FROM py_seed WHERE kind = 4""")
def q_py_exception_blocks(spark, d):
    return P.py_exception_blocks(_nodes(spark, d)).select("file_id", "path", "line_start", "line_end")
