"""Registered model-response queries (§2.6) over `model_responses`."""

from __future__ import annotations

from pyspark.sql import functions as F

import crx.sources.fixture_sql_resp  # noqa: F401
from crx.operators import responses as R
from crx.plans.registry import query
from crx.sources import fixtures as X
from crx.sources.fixture_sql import sql_str

_OK = "IN (0, 1, 2, 5)"


_ODD_JSON = [('{"a": 1, "a": 2}', "a=2"), ('{"a": NaN}', None), ('{"a": 1} and {"a": 2}', None), ('[1, 2]', None), ('x {"a": [1, {"b": 3}]} y', 'a=[1,{"b":3}]'),
             ('```json\n{"a": "f"}\n``` {"a": "g"}', "a=f"), ('```\nno\n``` then {"a": 5}', "a=5"), ("", None), ("}{", None), ('```json\n"s"\n```', "string:s")]


@query("extract_json", oracle=f"""
SELECT review_id, 'phase1' AS phase, 0::BIGINT AS seq, CASE WHEN v_p1 IN (3) THEN NULL ELSE 'object' END AS json_kind,
       CASE WHEN v_p1 {_OK} THEN 'Change ' || review_id::VARCHAR || ' has ' || coalesce(n_items, 0)::VARCHAR || ' items' END AS content
FROM resp_orders
UNION ALL SELECT review_id, 'security', 1, CASE WHEN v_sec = 3 THEN NULL ELSE 'object' END, NULL FROM resp_orders
UNION ALL SELECT review_id, 'logic', 2, CASE WHEN v_logic = 3 THEN NULL ELSE 'object' END, NULL FROM resp_orders
UNION ALL SELECT review_id, 'security', 3, 'object', NULL FROM resp_orders WHERE review_id % 4 = 0
UNION ALL SELECT review_id, 'odd', x.i::BIGINT, x.kind, x.content FROM resp_orders, (VALUES """ + ", ".join(
    f"({i}, {'NULL' if want is None else repr('string' if want.startswith('string:') else 'object')}, "
    f"{'NULL' if want is None else sql_str(want.split(':', 1)[1] if want.startswith('string:') else want.split('=', 1)[1])})"
    for i, (_, want) in enumerate(_ODD_JSON)) + """) x(i, kind, content) WHERE review_id % 50 = 0""")
def q_extract_json(spark, d):
    """Kind and a content field of every response, and of odd texts (repeated keys,
    trailing text, NaN, arrays, prose) for every fiftieth review."""
    real = X.model_responses(spark, d).select("review_id", "phase", "seq", "text")
    odd = (real.filter((F.col("seq") == 0) & (F.col("review_id") % 50 == 0))
           .select("review_id", F.lit("odd").alias("phase"),
                   F.posexplode(F.array(*[F.lit(t) for t, _ in _ODD_JSON])).alias("seq", "text")).withColumn("seq", F.col("seq").cast("bigint")))
    v = F.col("json")
    content = F.coalesce(F.try_variant_get(v, "$.summary", "string"), F.try_variant_get(v, "$.a", "string"), F.try_variant_get(v, "$", "string"))
    r = R.with_json(real.unionByName(odd))
    return r.select("review_id", "phase", "seq", R.json_kind(v).alias("json_kind"),
                    F.when(F.col("phase").isin("phase1", "odd"), F.when(F.col("seq").isNotNull() & ~content.startswith('{}'), content)).alias("content"))


@query("parse_phase1", oracle=f"""
SELECT review_id, 0::BIGINT AS seq,
  CASE WHEN v_p1 {_OK} THEN 'Change ' || review_id::VARCHAR || ' has ' || coalesce(n_items, 0)::VARCHAR || ' items'
       ELSE 'Failed to parse Phase 1 response' END AS summary,
  CASE WHEN v_p1 {_OK} THEN CASE WHEN review_id % 7 = 0 THEN 'low' ELSE ['low','medium','high'][(review_id % 3)::INT + 1] END
       ELSE 'medium' END AS risk_level,
  CASE WHEN v_p1 {_OK} THEN ['part ' || coalesce(min_part, 0)::VARCHAR, 'tests'] ELSE []::VARCHAR[] END AS key_changes,
  CASE WHEN v_p1 {_OK} THEN CASE review_id % 5 WHEN 1 THEN ['security'] WHEN 2 THEN ['logic','style']
       WHEN 3 THEN ['security','bogus','security'] ELSE []::VARCHAR[] END ELSE []::VARCHAR[] END AS analysis_directions,
  v_p1 {_OK} AS parsed
FROM resp_orders""")
def q_parse_phase1(spark, d):
    return R.parse_phase1(X.model_responses(spark, d).filter(F.col("phase") == "phase1"))


@query("parse_findings", oracle=f"""
SELECT o.review_id, 'security' AS phase, 1::BIGINT AS seq, CAST(i.rn - 1 AS INT) AS item_idx,
       i.rule_id, i.severity, i.category, i.file_path, i.line_start, i.line_end, i.title, i.description,
       i.suggestion, i.confidence, 'ai' AS source
FROM resp_orders o JOIN resp_item_exp i ON i.review_id = o.review_id WHERE o.v_sec {_OK}
UNION ALL
SELECT o.review_id, 'logic', 2::BIGINT, CAST(i.rn / 2 - 1 AS INT),
       i.rule_id, i.severity, i.category, i.file_path, i.line_start, i.line_end, i.title, i.description,
       i.suggestion, i.confidence, 'ai'
FROM resp_orders o JOIN resp_item_exp i ON i.review_id = o.review_id WHERE o.v_logic {_OK} AND i.rn % 2 = 0""")
def q_parse_findings(spark, d):
    return R.parse_findings(X.model_responses(spark, d).filter(F.col("phase") != "phase1"))


@query("select_directions", oracle=f"""
WITH p AS (
  SELECT review_id,
    CASE WHEN v_p1 {_OK} THEN CASE review_id % 5 WHEN 1 THEN ['security'] WHEN 2 THEN ['logic','style']
         WHEN 3 THEN ['security','bogus','security'] ELSE []::VARCHAR[] END ELSE []::VARCHAR[] END AS p1,
    CASE review_id % 4 WHEN 1 THEN []::VARCHAR[] WHEN 2 THEN ['style'] WHEN 3 THEN ['logic','security'] END AS ov
  FROM resp_orders),
 c AS (SELECT review_id, CASE WHEN len(coalesce(ov, [])) > 0 THEN ov WHEN len(p1) > 0 THEN p1
            ELSE ['security','logic','performance','style'] END AS ch FROM p),
 e AS (SELECT review_id, CAST(generate_subscripts(ch, 1) - 1 AS INT) AS idx, unnest(ch) AS direction FROM c)
SELECT * FROM e WHERE direction IN ('security','logic','performance','style')""")
def q_select_directions(spark, d):
    p1 = R.parse_phase1(X.model_responses(spark, d).filter(F.col("phase") == "phase1"))
    return R.select_directions(p1, X.direction_overrides(spark, d))


@query("token_usage", oracle="""
SELECT review_id, 'phase1' AS phase, CASE WHEN review_id % 9 = 0 THEN 0 ELSE 1300 + review_id % 100 + review_id % 50 END AS total_tokens FROM orders_r
UNION ALL SELECT review_id, 'security', CASE WHEN review_id % 9 = 0 THEN 0
    ELSE 1300 + review_id % 100 + review_id % 50 + CASE WHEN review_id % 4 = 0 THEN 3 ELSE 1 END END FROM orders_r
UNION ALL SELECT review_id, 'logic', CASE WHEN review_id % 9 = 0 THEN 0 ELSE 1302 + review_id % 100 + review_id % 50 END FROM orders_r""".replace(
    "FROM orders_r", "FROM (SELECT o_orderkey AS review_id FROM orders)"))
def q_token_usage(spark, d):
    return R.token_usage(X.model_responses(spark, d))
