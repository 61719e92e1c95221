"""Queries whose operators stay in DataFrame and SQL functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crx.llm.exact_dedup import exact_groups
from crx.llm.mixing import mixture
from crx.llm.pii import private_spans
from crx.llm.pii import report as pii_report
from crx.llm.queries import query, table
from crx.llm.secrets import report as secret_report
from crx.llm.secrets import secret_spans
from crx.llm.url_rules import judge_urls

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op4_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents),
g AS (SELECT norm, count(*) AS group_size, max(doc_id) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


@query("op7_mixing", """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5(concat_ws('|', '7', coalesce(doc_id::VARCHAR, ''))) AS key
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos
      FROM d GROUP BY source),
w AS (SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS cap_level,
             (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST)),
stop AS (SELECT arg_min(level, cap_level) AS level FROM o WHERE cap_level > level),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM stop) * weight), cap) AS target FROM o),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.key, 1, 15), d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken
FROM e
""")
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_url_rules", """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT p.page_id, p.host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule,
             arg_max(r.action, length(r.h || r.p)) AS action
      FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
      GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m
""")
def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(private_spans(table(spark, sf_dir, "documents")))


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(secret_spans(table(spark, sf_dir, "documents")))
