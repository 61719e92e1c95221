"""Model-response operators (§2.6): lenient JSON extraction and parsing.

Responses arrive as a table (review_id, phase, seq, text, usage); the network
call is outside this library. Everything here is JSON/variant expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four analysis directions, in default order.
DIRECTIONS = ["security", "logic", "performance", "style"]
FENCE_RE = r"(?sU)```(?:json)?\s*(.*?)```"
PHASE1_FAILED = "Failed to parse Phase 1 response"


ALLOW_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def _parsed(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else; else null."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def extract_json(text: Column) -> Column:
    """Variant of the first fenced block if it parses; else of the text from the
    first '{' to the last '}' if that parses; else null. Text after a value makes
    it invalid; of repeated keys the last counts (`with_json` sets the session
    option for that); NaN and Infinity, which are not JSON, are invalid."""
    fenced = _parsed(F.regexp_extract(text, FENCE_RE, 1))  # no block: empty, so null
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((first > 0) & (F.instr(text, "}") > 0) & (last >= first), _parsed(text.substr(first, last - first + 1)))
    return F.coalesce(fenced, braces)


def _fields(v: Column) -> Column:
    """The members of a JSON object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def json_kind(v: Column) -> Column:
    """'object', 'array', 'string', ... of a variant (null stays null)."""
    return (F.when(v.isNull(), F.lit(None))
             .when(_fields(v).isNotNull(), "object").when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "array")
             .otherwise(F.lower(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1))))


def _truthy_object(v: Column) -> Column:
    """A parsed, non-empty JSON object (the only shape the reference can use)."""
    return F.coalesce(F.size(_fields(v)) > 0, F.lit(False))


def _get(v: Column, path: str, typ: str, default) -> Column:
    return F.coalesce(F.try_variant_get(v, path, typ), F.lit(default).cast(typ) if not isinstance(default, Column) else default)


def with_json(responses: DataFrame) -> DataFrame:
    responses.sparkSession.conf.set(ALLOW_REPEATED_KEYS, "true")
    return responses.withColumn("json", extract_json(F.col("text")))


def parse_phase1(responses: DataFrame) -> DataFrame:
    """summary, risk_level, key_changes, analysis_directions per response.
    Missing fields default to "", "low", [], []; an unparsable, empty or
    non-object response gives the failure summary with risk 'medium'."""
    v = F.col("json")
    ok = _truthy_object(v)
    empty = F.array().cast("array<string>")
    strs = lambda p: F.coalesce(
        F.try_variant_get(v, p, "array<string>"), empty)
    return with_json(responses).select(
        "review_id", "seq",
        F.when(ok, _get(v, "$.summary", "string", "")).otherwise(F.lit(PHASE1_FAILED)).alias("summary"),
        F.when(ok, _get(v, "$.risk_level", "string", "low")).otherwise(F.lit("medium")).alias("risk_level"),
        F.when(ok, strs("$.key_changes")).otherwise(empty).alias("key_changes"),
        F.when(ok, strs("$.analysis_directions")).otherwise(empty).alias("analysis_directions"),
        ok.alias("parsed"))


def parse_findings(responses: DataFrame) -> DataFrame:
    """One row per object in the response's `findings` array, with defaults;
    not-a-list gives none, non-object items are skipped; source is 'ai'."""
    v = F.col("json")
    items = F.when(_truthy_object(v), F.try_variant_get(v, "$.findings", "array<variant>"))
    exploded = with_json(responses).select(
        "review_id", "phase", "seq", F.posexplode(items).alias("item_idx", "item"))
    it = F.col("item")
    return exploded.filter(_fields(it).isNotNull()).select(
        "review_id", "phase", "seq", "item_idx",
        _get(it, "$.rule_id", "string", "AI-UNKNOWN").alias("rule_id"),
        _get(it, "$.severity", "string", "warning").alias("severity"),
        _get(it, "$.category", "string", "logic").alias("category"),
        _get(it, "$.file_path", "string", "").alias("file_path"),
        _get(it, "$.line_start", "bigint", 1).alias("line_start"),
        _get(it, "$.line_end", "bigint", 1).alias("line_end"),
        _get(it, "$.title", "string", "").alias("title"),
        _get(it, "$.description", "string", "").alias("description"),
        _get(it, "$.suggestion", "string", "").alias("suggestion"),
        _get(it, "$.confidence", "double", 0.5).alias("confidence"),
        F.lit("ai").alias("source"))


def select_directions(phase1: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(review_id, idx, direction): non-empty override, else the phase-1 list,
    else all four; unknown names dropped, order and repeats kept."""
    p = phase1.select("review_id", F.col("analysis_directions").alias("p1"))
    if overrides is not None:
        p = p.join(overrides.select("review_id", F.col("directions").alias("ov")), "review_id", "left")
    else:
        p = p.withColumn("ov", F.lit(None).cast("array<string>"))
    chosen = (F.when(F.coalesce(F.size("ov"), F.lit(0)) > 0, F.col("ov"))
               .when(F.coalesce(F.size("p1"), F.lit(0)) > 0, F.col("p1"))
               .otherwise(F.array(*[F.lit(d) for d in DIRECTIONS])))
    return (p.select("review_id", F.posexplode(chosen).alias("idx", "direction"))
            .filter(F.col("direction").isin(DIRECTIONS)))


def token_usage(responses: DataFrame) -> DataFrame:
    """Tokens per review and phase (usage.total_tokens, missing -> 0); a
    repeated phase keeps the last response."""
    tokens = F.coalesce(F.element_at(F.col("usage"), F.lit("total_tokens")), F.lit(0)).cast("long")
    return (responses.select("review_id", "phase", "seq", tokens.alias("t"))
            .groupBy("review_id", "phase")
            .agg(F.max_by("t", "seq").alias("total_tokens")))
