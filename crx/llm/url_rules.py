"""URL rules as a sort-merge range join.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's. Canonical keys have the host's labels reversed, then the path,
so a rule covers one interval of keys: [key, key + 0xFF). A url looks itself up
once per ancestor of its host (no deeper than the rules go). Rule starts, rule
ends and lookups are sorted together and swept once; intervals nest, so the
innermost open rule is what the last event says: a start opens its rule, an end
returns to the rule around it, which is the stack, kept as one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crx.llm.common import ascii_lower, shared_table, shuffle_width

NO_RULE = -1


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; without ://: empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; without ://: empty."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, "\\.", -1)))


def _key(labels: Column, path: Column) -> Column:
    """Reversed host labels, then the path. No host holds / or ?, so these part the
    labels and the path without doubt, whatever else a label holds."""
    return F.encode(F.concat(F.array_join(labels, "/"), F.lit("?"), path), "utf-8")


def _numbered_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): rule_id, key, parent_id, labels, rule, action."""
    clean = (rules.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
                          F.coalesce("path", F.lit("")).alias("path"), "action")
             .filter(~F.col("host").rlike("[/?#]"))
             .groupBy("host", "path").agg(F.max("action").alias("action")))
    keyed = clean.select("*", _labels(F.col("host")).alias("labels"), F.concat("host", "path").alias("rule"),
                         F.conv(F.substring(F.md5(F.concat("host", F.lit("?"), "path")), 1, 15), 16, 10)
                         .cast("long").alias("rule_id"))
    shorter = keyed.filter(F.length("path") > 0).select(
        "rule_id", "host", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"), "path")
    parents = (shorter.select("rule_id", "host", "n", F.col("path").substr(F.lit(1), F.col("n")).alias("path"))
               .join(keyed.select(F.col("rule_id").alias("outer_id"), "host", "path"), ["host", "path"])
               .groupBy("rule_id").agg(F.max_by("outer_id", "n").alias("parent_id")))
    return keyed.join(parents, "rule_id", "left").withColumn("parent_id", F.coalesce("parent_id", F.lit(NO_RULE)))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict.

    `rules` has host, path, action. The longest fitting rule (host and path
    together, ties: the longer host) gives rule (host + path) and verdict; without
    one, rule is null and verdict is `default`. Rules repeated with both actions
    count as the greater name ("block" beats "allow"); a rule with an empty host
    fits every url; one whose host holds / ? or # fits none. A null url, or one without ://, has empty host and path. Rows
    repeated in `pages` are repeated in the result; an empty table on either side
    is fine; other columns are ignored."""
    numbered = shared_table(_numbered_rules(rules), "url-rules")
    deepest = numbered.agg(F.max(F.size("labels"))).first()[0] or 0
    urls = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
            .groupBy("id", "url").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("host", F.coalesce(url_host(F.col("url")), F.lit("")))
            .withColumn("path", F.coalesce(url_path(F.col("url")), F.lit(""))))
    labels = _labels(F.col("host"))
    none = F.lit(None)
    lookups = (urls.withColumn("labels", labels)
               .withColumn("level", F.explode(F.sequence(F.lit(0), F.least(F.size("labels"), F.lit(deepest)))))
               .select(_key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"),
                       none.cast("long").alias("says"), F.xxhash64("id", "url").alias("salt"),
                       "id", "url", "host", "path", "n_rows"))
    pad = [none.cast(dict(urls.dtypes)[c]).alias(c) for c in ("id", "url", "host", "path", "n_rows")]
    rule_key = _key(F.col("labels"), F.col("path"))
    opens = numbered.select(rule_key.alias("key"), F.col("rule_id").alias("says"), F.lit(0).cast("long").alias("salt"), *pad)
    shuts = numbered.select(F.concat(rule_key, F.unhex(F.lit("FF"))).alias("key"), F.col("parent_id").alias("says"),
                            F.lit(0).cast("long").alias("salt"), *pad)
    width = shuffle_width(pages)
    events = shared_table(
        opens.unionByName(shuts).unionByName(lookups).withColumn("is_lookup", F.col("says").isNull())
        .repartitionByRange(width, "key", "is_lookup", "salt").withColumn("part", F.spark_partition_id()), "url-events")
    inside = (Window.partitionBy("part").orderBy("key", "is_lookup")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = events.withColumn("open", F.last("says", ignorenulls=True).over(inside))
    # what is still open at the start of each part: one row per part
    ends = events.groupBy("part").agg(F.max_by("says", F.when(~F.col("is_lookup"), F.col("key"))).alias("last_says"))
    carry = ends.select("part", F.last("last_says", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = (swept.filter("is_lookup").join(F.broadcast(carry), "part")  # one row per part
             .withColumn("rule_id", F.coalesce("open", "carried", F.lit(NO_RULE)))
             .join(numbered.select("rule_id", "rule", "action", F.length("host").alias("host_len")), "rule_id", "left"))
    best = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), F.col("host_len"), F.col("rule"), F.col("action")))
    return (found.groupBy("id", "url").agg(F.max(best).alias("best"), F.first("host").alias("host"),
                                           F.first("path").alias("path"), F.first("n_rows").alias("n_rows"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict")))
