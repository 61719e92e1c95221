"""Source divergence audit: how far the sources of a language differ in their terms.

Terms are counted inside the scan, so the shuffle carries one row per term, group
and task. Two tables follow. `pair` sums a divergence over all kept terms of a
language for every two of its sources: terms that neither has add a constant, terms
that one has follow from how often it has each count, and only terms that both have
are joined. `term` ranks a source's own terms. There, value grows with the count in
the group and falls with the count in the language, so a term with k others of at
least its group count, at most its language count and an earlier name cannot be
among the first k: partitions keep their dominance skyband, the skybands are merged
in the same way, and what is left is ranked exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crx.llm.common import shared_table
from crx.plans.session import ship_package

RUN_BYTES = 16 << 20  # text whose terms are counted at once
HELD_ROWS = 20_000  # rows of a group a task holds before it cuts them to their skyband
MERGE_SALTS = 16  # tasks a group's skybands are merged in before the exact ranking
BLOCK = 256
# ASCII letters lower-cased, other ASCII as a space, further bytes (UTF-8) as they are
_AS_TERMS = bytes(b if b > 0x7F else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))

GROUP = ["lang", "source"]
COUNTED = "lang string, source string, term string, occurrences long, documents long"
BAND = "lang string, source string, term string, occurrences long, lang_count long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, source, text as bytes): occurrences and documents of
    each term, counted run by run of documents."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // RUN_BYTES)) + 1
        for start, end in itertools.pairwise([0, *cuts.tolist(), batch.num_rows]):
            if start < end:
                yield _count_run(batch.slice(start, end - start))


def _count_run(run: pa.RecordBatch) -> pa.RecordBatch:
    texts = pa.array([t.translate(_AS_TERMS) for t in run.column(2).to_pylist()], pa.large_binary()).cast(pa.large_string())
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    full = pc.not_equal(terms, "").to_numpy(zero_copy_only=False)[code] if len(terms) else np.empty(0, dtype=bool)
    groups, group = _group_codes(run)
    n = max(len(terms), 1)
    in_doc, times = np.unique(doc[full] * n + code[full], return_counts=True)
    key, at = np.unique(group[in_doc // n] * n + in_doc % n, return_inverse=True)
    own = groups.take(pa.array(key // n))
    return pa.RecordBatch.from_arrays(
        [own.field(0), own.field(1), terms.take(pa.array(key % n)).cast(pa.string()),
         pa.array(np.bincount(at, times, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))],
        names=["lang", "source", "term", "occurrences", "documents"])


def _group_codes(run: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray]:
    """The distinct (lang, source) of a run and the number of each row's."""
    both = [c.dictionary_encode() for c in run.columns[:2]]
    lang, source = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in both)
    n = max(len(both[1].dictionary), 1)
    pairs, group = np.unique(lang * n + source, return_inverse=True)
    fields = [both[0].dictionary.take(pa.array(pairs // n)), both[1].dictionary.take(pa.array(pairs % n))]
    return pa.StructArray.from_arrays(fields, ["lang", "source"]), group


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per lang, source and term: occurrences, documents. Null text, lang and
    source are empty; a repeated row is a document of its own."""
    ship_package(docs.sparkSession)
    clean = [F.coalesce(F.col(c), F.lit("")) for c in (lang_col, source_col, text_col)]
    rows = docs.select(clean[0].alias("lang"), clean[1].alias("source"), clean[2].cast("binary").alias("text"))
    return (rows.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term")
            .agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")))


def skyband(count: np.ndarray, lang_count: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Indices of the points with fewer than `k` others of at least their count, at most
    their lang_count and a smaller rank (ranks differ).

    In the order below dominators come first. A point with k dominators has k of them
    in the band, so points are held against the band so far, and inside a block
    against all points before them."""
    order = np.lexsort((rank, lang_count, -count))
    level, name = lang_count[order], rank[order]
    band = np.empty(0, dtype=np.int64)
    for start in range(0, len(order), BLOCK):
        own_level, own_name = level[start:start + BLOCK, None], name[start:start + BLOCK, None]
        before = ((level[band] <= own_level) & (name[band] < own_name)).sum(axis=1)
        inside = (own_level.T <= own_level) & (own_name.T < own_name)
        before += np.tril(inside, -1).sum(axis=1)
        band = np.concatenate([band, start + np.flatnonzero(before < k)])
    return order[band]


def _band(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over BAND rows: the skyband of each group's rows in the partition."""
    def cut(rows: list[tuple]) -> list[tuple]:
        rank = np.empty(len(rows), dtype=np.int64)
        rank[sorted(range(len(rows)), key=lambda i: rows[i][0])] = np.arange(len(rows))
        counts = np.array([r[1:] for r in rows], dtype=np.int64)
        return [rows[i] for i in skyband(counts[:, 0], counts[:, 1], rank, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[tuple]] = {}
        limit: dict[tuple[str, str], int] = {}
        for batch in batches:
            lang, source, term, own, total = (c.to_pylist() for c in batch.columns)
            for group, row in zip(zip(lang, source, strict=True), zip(term, own, total, strict=True), strict=True):
                rows = held.setdefault(group, [])
                rows.append(row)
                if len(rows) >= limit.get(group, HELD_ROWS):
                    held[group] = cut(rows)
                    limit[group] = 2 * len(held[group]) + HELD_ROWS
        for (lang, source), rows in held.items():
            terms, own, total = zip(*cut(rows), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(terms, pa.string()), pa.array(own, pa.int64()), pa.array(total, pa.int64())],
                names=["lang", "source", "term", "occurrences", "lang_count"])
    return run


def term_skyband(kept: DataFrame, k: int) -> DataFrame:
    """Rows of `kept` (BAND columns; a term once per group) with fewer than `k`
    dominators: first inside each partition, then over a group's skybands in
    MERGE_SALTS tasks, so that a hot group meets in no single task."""
    local = kept.select("lang", "source", "term", "occurrences", "lang_count").mapInArrow(_band(k), BAND)
    dealt = local.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE_SALTS)))
    return dealt.mapInArrow(_band(k), BAND)


def share(count: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(10^9 (count + 2) / (total + 2 terms)); decimals, so that no
    corpus overflows it."""
    return f"1 + (1000000000BD * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))"


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so longs hold it."""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _groups(docs: DataFrame, kept: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """One row per occurring (lang, source): total, n_terms, lang_terms, lang_total,
    zero (the share of a kept term it doesn't have; null without kept terms)."""
    names = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))])
    own = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"), F.count(F.lit(1)).alias("n_terms"))
    langs = (kept.groupBy("lang", "term").agg(F.first("lang_count").alias("lang_count"))
             .groupBy("lang").agg(F.count(F.lit(1)).alias("lang_terms"), F.sum("lang_count").alias("lang_total")))
    joined = names.distinct().join(own, GROUP, "left").join(langs, "lang", "left").na.fill(0)
    return joined.withColumn("zero", F.when(F.col("lang_terms") > 0, F.expr(share("0", "total", "lang_terms"))))


def source_pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang), value."""
    rows = (kept.join(groups.select("lang", "source", "total", "lang_terms", "zero"), GROUP)
            .withColumn("p", F.expr(share("occurrences", "total", "lang_terms"))))
    a, b = rows.select("lang", "term", "source", "p", "zero"), rows.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("zero").alias("none"))
    # terms of both: what they give, less what the sums below take them to give
    both = (a.join(b, ["lang", "term"]).filter("source < item")
            .groupBy("lang", "source", "item")
            .agg(F.sum(F.expr(f"{gap('p', 'q')} - {gap('p', 'none')} - {gap('zero', 'q')} + {gap('zero', 'none')}")).alias("value")))
    both = both.union(both.select("lang", F.col("item"), F.col("source"), "value"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("none"), F.col("n_terms").alias("other_terms"))
    # terms of one: by its counts, of which there are few
    levels = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    one = (levels.join(others, "lang").filter("source != item")
           .groupBy("lang", "source", "item").agg(F.sum(F.expr(f"n * ({gap('p', 'none')})")).alias("value")))
    one = one.union(one.select("lang", F.col("item"), F.col("source"), "value"))
    # terms of neither
    rest = F.expr(f"(lang_terms - n_terms - other_terms) * ({gap('zero', 'none')})")
    neither = groups.join(others, "lang").filter("source != item").select("lang", "source", "item", F.coalesce(rest, F.lit(0)).alias("value"))
    return (neither.union(both).union(one).groupBy("lang", "source", "item")
            .agg(F.sum("value").cast("long").alias("value")))


def divergence_report(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                      min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for every occurring (lang, source) its
    divergence from each other source of the lang (`pair`, all ranks) and its `top`
    terms over the lang's own share (`term`).

    Terms are runs of ASCII letters and other non-ASCII characters, A-Z lower-cased; a
    lang keeps those in at least `min_docs` of its documents. Null text, lang and
    source read as empty; a repeated row is a document of its own; a group without
    terms has its pairs, and value 0 where the lang keeps no term. Equal values rank
    by UTF-8. An empty table gives an empty result; other columns are ignored."""
    counts = shared_table(term_counts(docs, text_col, lang_col, source_col), "term-counts")
    langs = (counts.groupBy("lang", "term").agg(F.sum("occurrences").alias("lang_count"), F.sum("documents").alias("lang_docs"))
             .filter(F.col("lang_docs") >= min_docs))
    kept = shared_table(counts.join(langs, ["lang", "term"]).select("lang", "source", "term", "occurrences", "lang_count"), "kept-terms")
    groups = shared_table(_groups(docs, kept, lang_col, source_col), "term-groups")
    pairs = source_pairs(groups, kept).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    band = (term_skyband(kept, top).join(groups, GROUP)
            .withColumn("p", F.expr(share("occurrences", "total", "lang_terms")))
            .withColumn("q", F.expr(share("lang_count", "lang_total", "lang_terms"))).filter("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value")))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    first = band.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(first)
