"""Secrets by pattern, and random strings by a battery of tests.

Base spans (assignments, access keys, hex) are found by pattern. Beside them, any
token of MIN_TOKEN or more symbols is a candidate, letters alone included: its
encoding is inferred, and over that alphabet it is tested for uniformity
(chi-squared), for runs above and below the middle symbol, and for serial
correlation. The three deviations make one score, small for random strings.

What ordinary language looks like comes from the corpus: a chain of symbol pairs,
pooled over words of all lengths, in which + / - _ may join a word to the next, as
in paths and identifiers. A token's evidence is the log-likelihood ratio of random
symbols (over its alphabet, at its length) to that chain, less the weighted score.
Under the chain the ratio has mean 1 at most, so exp(-evidence) bounds the p-value
at any length, however few tokens of that length there are. The
Benjamini-Hochberg rule over all candidates keeps the false discoveries among the
tokens reported below `false_rate`. Counts are of distinct words and tokens, so
copies weigh nothing.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crx.llm.common import shared_table, text_of
from crx.llm.spans import count_kind, listed, matches, of_kind

KINDS = ("assign", "access", "hex")
_ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*+[:=]\\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
PATTERNS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{16,}+", "hex": "(?<![0-9a-f])[0-9a-f]{24,}+"}
MIN_TOKEN = 20
TOKEN_RE = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}+={{0,2}}+"
WORD_RE = "[A-Za-z0-9+/_-]++"
BINS_PER_UNIT, MAX_BIN = 4, 400
FOLDS = 2
BATTERY_WEIGHT = 1.5  # of the battery's score against the likelihood ratio

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# (form of the token, symbols in their order): the first form that fits is the encoding
ENCODINGS = [("^[0-9]+$", _DIGITS), ("^[0-9a-f]+$", _DIGITS + "abcdef"), ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
             ("^[0-9a-f-]+$", _DIGITS + "abcdef-"), ("^[0-9A-F-]+$", _DIGITS + "ABCDEF-"),
             ("^[A-Z2-7]+=*$", _UPPER + "234567"), ("^[a-z]+$", _LOWER), ("^[a-z0-9]+$", _LOWER + _DIGITS), ("^[A-Z0-9]+$", _UPPER + _DIGITS),
             ("^[A-Za-z]+$", _UPPER + _LOWER), ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS), ("", _UPPER + _LOWER + _DIGITS + "+/-_")]
SYMBOLS = ENCODINGS[-1][1]
SEPARATORS = "+/-_"


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind as listed."""
    assign = F.filter(matches(text, PATTERNS["assign"]), lambda s: F.length(F.regexp_extract(s["value"], _ASSIGN, 1)) >= 6)
    found = [of_kind(assign, "assign", 0)] + [of_kind(matches(text, PATTERNS[k]), k, i) for i, k in enumerate(KINDS) if i]
    return F.array_sort(F.concat(*found))


def _alphabet(token: Column) -> Column:
    alphabet = F.lit(SYMBOLS)
    for form, symbols in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(form), F.lit(symbols)).otherwise(alphabet)
    return alphabet


def _fold(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FOLDS)).cast("int")


def _places(word: Column, alphabet: Column) -> Column:
    """Positions, from 1, of a word's symbols in the alphabet."""
    return F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, alphabet))


def _pairs(places: Column) -> Column:
    """Each symbol with the one before it, 0 before the first: i * len(SYMBOLS) + j."""
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(places, F.lit(1), F.size(places) - 1)), places, lambda i, j: i * len(SYMBOLS) + j)


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds `score` to rows with a `token`: squared deviations of the three tests from
    what random symbols give, summed."""
    plain = F.regexp_replace("token", "=+$", "")
    rows = tokens.withColumn("alphabet", _alphabet(F.col("token"))).withColumn("plain", plain)
    rows = (rows.withColumn("x", _places(F.col("plain"), F.col("alphabet"))).withColumn("n", F.size("x").cast("double")).withColumn("k", F.length("alphabet").cast("double"))
            .withColumn("mean", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.col("n"))
            .withColumn("next", F.arrays_zip(F.slice("x", F.lit(1), F.size("x") - 1).alias("a"), F.slice("x", F.lit(2), F.size("x") - 1).alias("b"))))
    squares = F.aggregate(F.array_distinct("x"), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter("x", lambda w: w == v)).cast("double"), F.lit(2.0)))
    chi = F.col("k") / F.col("n") * squares - F.col("n")
    z_uniform = F.greatest((chi - (F.col("k") - 1)) / F.sqrt(2 * (F.col("k") - 1)), F.lit(0.0))
    middle = (F.col("k") + 1) / 2
    high = F.size(F.filter("x", lambda v: v > middle)).cast("double")
    runs = 1.0 + F.size(F.filter("next", lambda p: (p["a"] > middle) != (p["b"] > middle)))
    expected = 2 * high * (F.col("n") - high) / F.col("n") + 1
    spread = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    z_runs = F.when(spread > 0, (runs - expected) / F.sqrt(spread)).otherwise(F.sqrt("n"))
    around = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(v - F.col("mean"), F.lit(2.0)))
    along = F.aggregate("next", F.lit(0.0), lambda a, p: a + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    z_serial = F.when(around > 0, F.sqrt("n") * along / around).otherwise(F.sqrt("n"))
    score = F.pow(z_uniform, F.lit(2.0)) + F.pow(z_runs, F.lit(2.0)) + F.pow(z_serial, F.lit(2.0))
    return rows.select(*tokens.columns, score.alias("score"))


def ordinary_pairs(docs: DataFrame, text_col: str) -> dict[int, dict[int, int]]:
    """Per fold the counts of symbol pairs in ordinary words: distinct words of all
    texts too short to be candidates, in every fold, and longer ones of lower-case
    letters (the first may be a capital) in all folds but their own, so no token is
    judged by itself. The end of a word counts as a pair with each separator. At most
    one number per fold and pair."""
    word = F.col("word")
    long = F.length(word) >= MIN_TOKEN
    words = (docs.select(F.explode(F.array_distinct(F.regexp_extract_all(text_of(text_col), F.lit(WORD_RE), F.lit(0)))).alias("word"))
             .filter(~long | word.rlike("^[A-Z]?[a-z]+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n_texts")))
    folds = F.filter(F.array(*[F.lit(i) for i in range(FOLDS)]), lambda f: ~long | (f != _fold(word)))
    last = F.call_function("locate", F.substring(word, -1, 1), F.lit(SYMBOLS))
    joined = F.array(*[last * len(SYMBOLS) + SYMBOLS.index(c) + 1 for c in SEPARATORS])
    counts = (words.select(folds.alias("folds"), F.explode(F.concat(_pairs(_places(word, F.lit(SYMBOLS))), joined)).alias("pair"))
              .select(F.explode("folds").alias("fold"), "pair").groupBy("fold", "pair").agg(F.count(F.lit(1)).alias("n")))
    found: dict[int, dict[int, int]] = defaultdict(dict)
    for r in counts.collect():
        found[r["fold"]][r["pair"]] = r["n"]
    return found


def _chain(counts: dict[int, int]) -> tuple[Column, Column]:
    """Arrays (seen, spare) of the chain: symbol j follows i with probability
    seen[i, j] + spare[i] / k, k the size of the token's alphabet. A row backs off to
    single symbols by its number of different followers plus one (Witten-Bell), and
    these to equal chances; from no words at all every symbol has 1 / k. After a
    separator a word may begin as at the start."""
    n = len(SYMBOLS)
    counts = defaultdict(int, counts)
    for i in (SYMBOLS.index(c) + 1 for c in SEPARATORS):
        for j in range(1, n + 1):
            if counts.get(j):
                counts[i * n + j] += counts[j]
    after, kinds, single = [0] * (n + 1), [1] * (n + 1), [0] * (n + 1)
    for pair, c in counts.items():
        i, j = divmod(pair - 1, n)
        after[i] += c
        kinds[i] += 1
        single[j + 1] += c
    total = sum(single) + n
    seen = [(counts.get(i * n + j, 0) + kinds[i] * single[j] / total) / (after[i] + kinds[i]) for i in range(n + 1) for j in range(1, n + 1)]
    spare = [kinds[i] * n / total / (after[i] + kinds[i]) for i in range(n + 1)]
    as_column = lambda values: F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")
    return as_column(seen), as_column(spare)


def evidence(tokens: DataFrame, ordinary: dict[int, dict[int, int]]) -> DataFrame:
    """Adds `evidence` to rows with a `token`: log-likelihood ratio of random symbols
    to the ordinary chain, less the weighted score of the battery (which only lowers
    the ratio's mean under the chain) and the logarithm of the number of encodings."""
    n = len(SYMBOLS)
    plain = F.regexp_replace("token", "=+$", "")
    rows = (randomness(tokens).withColumn("k", F.length(_alphabet(F.col("token"))).cast("double"))
            .withColumn("pairs", _pairs(_places(plain, F.lit(SYMBOLS)))))
    ratio = F.lit(None).cast("double")
    for fold in range(FOLDS):
        seen, spare = _chain(ordinary.get(fold, {}))
        one = F.aggregate("pairs", F.lit(0.0), lambda a, at: a - F.log(F.col("k") * F.element_at(seen, at) + F.element_at(  # noqa: B023
            spare, F.floor((at - 1) / n).cast("int") + 1)))  # noqa: B023
        ratio = F.when(_fold(F.col("token")) == fold, one).otherwise(ratio)
    return rows.select(*tokens.columns, (ratio - BATTERY_WEIGHT * F.col("score") - math.log(len(ENCODINGS))).alias("evidence"))


def discoveries(scored: DataFrame, false_rate: float) -> DataFrame:
    """(least): one row, the lowest evidence bin reported, null if none is. scored:
    (bin), a row per distinct candidate; the p-value of a bin is that of its lower
    end. The table it works on has a row per bin, whatever the corpus."""
    histogram = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("found")).withColumn("all", F.lit(0))
    whole = Window.partitionBy("all")
    down = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = F.exp(-F.col("bin") / BINS_PER_UNIT) * F.sum("found").over(whole) / F.sum("found").over(down)
    return histogram.withColumn("q", q).agg(F.min(F.when(F.col("q") <= false_rate, F.col("bin"))).alias("least"))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_rate: float = 0.05) -> DataFrame:
    """One row per input row: doc_id, text_hash, base, random: arrays of spans
    (start, order, kind, end, value); random spans overlap no base span.

    Null text is empty; a repeated row has the same spans each time; an empty table
    gives an empty result; other columns are ignored. Tokens that lie in base spans
    wherever they stand are no candidates. A corpus without ordinary words to compare
    with reports nothing."""
    text = text_of(text_col)
    scan = shared_table(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), base_spans(text).alias("base"),
                                    matches(text, TOKEN_RE).alias("tokens")), "secret-scan")
    clear = ~F.exists("base", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start")))
    seen = (scan.select("doc_id", "text_hash", "base", F.explode("tokens").alias("t"))
            .filter(F.col("t.value").rlike("[A-Za-z0-9]") & clear).select("doc_id", "text_hash", "t", F.col("t.value").alias("token")))
    distinct = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n_seen")).select("token")
    bin_of = F.least(F.greatest(F.floor(F.col("evidence") * BINS_PER_UNIT), F.lit(0)), F.lit(MAX_BIN)).cast("int")
    scored = shared_table(evidence(distinct, ordinary_pairs(docs, text_col)).select("token", bin_of.alias("bin")), "secret-scores")
    least = discoveries(scored, false_rate).first()["least"]
    chosen = scored.filter(F.col("bin") >= F.lit(least)).select("token")
    added = (seen.join(chosen, "token").select("doc_id", "text_hash", "t").distinct()
             .groupBy("doc_id", "text_hash")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("t.start").alias("start"), F.lit(len(KINDS)).alias("order"), F.lit("random").alias("kind"),
                                                       F.col("t.end").alias("end"), F.col("t.value").alias("value")))).alias("random")))
    rows = scan.select("doc_id", "text_hash", "base")
    on = rows["doc_id"].eqNullSafe(added["doc_id"]) & (rows["text_hash"] == added["text_hash"])
    return rows.join(added, on, "left").select(
        rows["doc_id"], rows["text_hash"], "base",
        F.coalesce("random", F.array().cast("array<struct<start:long,order:int,kind:string,end:long,value:string>>")).alias("random"))


def report(spans: DataFrame) -> DataFrame:
    """Counts, the base digest and the list of all spans, from `secret_spans`."""
    every = F.array_sort(F.concat("base", "random"))
    return spans.select("doc_id", *[count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"))
