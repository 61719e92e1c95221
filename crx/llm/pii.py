"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP address, card, phone) are found by pattern. Each distinct
value is a protected entity. From the whole corpus come N texts, the texts df(c)
with an entity, df(t) with a term, and df(c, t) with the term near the entity. A
term reveals an entity when their pointwise mutual information
log(N df(c,t) / (df(c) df(t))) reaches a share of the entity's information
log(N / df(c)): from GENERALISE it is generalised, from REMOVE removed. It must do
so in two different contexts, so copies of one text prove nothing. The window about
an entity serves the statistics only: a term that reveals one is marked wherever it
stands, in all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crx.llm.common import shared_table, text_of
from crx.llm.spans import count_kind, listed, matches, of_kind

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    "email": f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\\.[{_LABEL}]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}+",
    "card": "[0-9](?:[\\x20-]?[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
CONTEXT_CHARS = 60
TERM_RE = "\\p{L}{4,}+"
GENERALISE, REMOVE, MIN_CONTEXTS = 0.75, 0.95, 2


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
                          .otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match counts: IP parts, digits and check sum of a card, digits of a phone."""
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    n_digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "card":
        return n_digits.between(12, 19) & _luhn(value)
    return n_digits.between(9, 15) if kind == "phone" else F.lit(True)


def _valid(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _holds(kind, s["value"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind as listed."""
    found = [of_kind(_valid(k, matches(text, PATTERNS[k])), k, i) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def _entity(kind: Column, value: Column) -> Column:
    plain = F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value))
    return F.concat(kind, F.lit(":"), plain)


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE,
                  remove: float = REMOVE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """One row per input row: doc_id, text_hash, base, terms.

    base: the base spans; terms: spans of terms that reveal an entity, wherever they
    stand, with kind generalise or remove (the stronger where a term reveals several),
    none overlapping a base span. Both are arrays of
    (start, order, kind, end, value). Null text is empty; a repeated row has the
    same spans each time; an empty table gives an empty result; other columns are
    ignored."""
    text = text_of(text_col)
    seen = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"))
    context = F.transform("base", lambda s: F.struct(
        _entity(s["kind"], s["value"]).alias("entity"),
        F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)).alias("at"),
        F.col("text").substr((F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + 1).cast("int"),
                             (s["end"] - F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)) + CONTEXT_CHARS).cast("int")).alias("around")))
    scan = shared_table(seen.select("doc_id", "text_hash", "base", context.alias("contexts")), "pii-scan")
    n_texts = scan.count()

    near = (scan.filter(F.size("base") > 0).select("doc_id", "text_hash", "base", F.explode("contexts").alias("c"))
            .select("doc_id", "text_hash", "base", "c.entity", "c.at", F.xxhash64("c.around").alias("context"),
                    F.length("c.around").alias("n"), F.explode(matches(F.col("c.around"), TERM_RE)).alias("t"))
            # words cut by the window's edge are not terms; nor are parts of a base span
            .filter(((F.col("t.start") > 0) | (F.col("at") == 0)) & (F.col("t.end") < F.col("n")))
            .select("doc_id", "text_hash", "entity", "context", F.lower("t.value").alias("term"),
                    (F.col("at") + F.col("t.start")).alias("start"), (F.col("at") + F.col("t.end")).alias("end"), "base")
            .filter(~F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))))
            .select("doc_id", "text_hash", "entity", "context", "term"))
    near = shared_table(near, "pii-near")
    with_entity = (scan.select("doc_id", "text_hash", F.explode(F.array_distinct(F.col("contexts.entity"))).alias("entity"))
                   .groupBy("entity").agg(F.count(F.lit(1)).alias("df_c")))
    contexts = near.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("x")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_contexts"))
    together = (near.select("entity", "term", "doc_id", "text_hash").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_ct"))
                .join(contexts.filter(F.col("n_contexts") >= min_contexts), ["entity", "term"]))
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_RE), F.lit(0)), lambda t: F.lower(t)))
    with_term = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    pmi = F.log(F.lit(float(n_texts)) * F.col("df_ct") / (F.col("df_c") * F.col("df_t")))
    information = F.log(F.lit(float(n_texts)) / F.col("df_c"))
    disclosing = shared_table(
        together.join(with_entity, "entity").join(with_term, "term")
        .filter((information > 0) & (pmi >= generalise * information))
        .groupBy("term").agg(F.max(F.when(pmi >= remove * information, "remove").otherwise("generalise")).alias("kind")), "pii-disclosing")
    # only texts that hold such a term are read for its places
    holding = (docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.explode(words).alias("term"))
               .join(disclosing, "term").select("doc_id", "text_hash", "term", "kind").distinct()
               .groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")))
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    held = (whole.join(holding, whole["id"].eqNullSafe(holding["doc_id"]) & (whole["hash"] == holding["text_hash"]))
            .dropDuplicates(["doc_id", "text_hash"]).withColumn("spans", base_spans(F.col("text"))))
    found = F.transform(matches(F.col("text"), TERM_RE, lambda t: F.map_contains_key("kinds", F.lower(t))), lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("order"), F.element_at("kinds", F.lower(t["value"])).alias("kind"),
        t["end"].alias("end"), F.lower(t["value"]).alias("value")))
    clear = F.filter(found, lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))
    added = held.select("doc_id", "text_hash", clear.alias("terms"))
    rows = scan.select("doc_id", "text_hash", "base")
    on = rows["doc_id"].eqNullSafe(added["doc_id"]) & (rows["text_hash"] == added["text_hash"])
    return (rows.join(added, on, "left").select(
        rows["doc_id"], rows["text_hash"], "base",
        F.coalesce("terms", F.array().cast("array<struct<start:long,order:int,kind:string,end:long,value:string>>")).alias("terms")))


def report(spans: DataFrame) -> DataFrame:
    """Counts, the base digest and the list of all spans, from `private_spans`."""
    every = F.array_sort(F.concat("base", "terms"))
    return spans.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents, all columns kept, with base spans replaced by [EMAIL] and so on,
    terms to generalise by [TERM], terms to remove by nothing. Null text stays null."""
    spans = private_spans(docs, id_col, text_col, **params).dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"),
                       text_of(text_col).alias("row_text"), F.xxhash64(text_of(text_col)).alias("row_hash"))
    joined = rows.join(spans, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")))
    joined = joined.select("row", "row_text", F.array_sort(F.concat("base", "terms")).alias("every"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.col("row_text").substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], kept, tag).alias("out")))

    clean = F.aggregate("every", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step,
                        lambda acc: F.concat(acc["out"], F.col("row_text").substr((acc["at"] + 1).cast("int"), F.length("row_text"))))
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), clean)
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
