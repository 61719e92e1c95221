"""Document fingerprints: MinHash over word shingles, in numpy inside tasks.

A fingerprint is one 16-bit value per universal hash permutation, written in hex;
the likeness of two is the share of equal values, which estimates the Jaccard
similarity of their shingle sets. `similar_documents` compares all members of each
signature band, block against block, and verifies Jaccard exactly; `edit_report` compares each document with an
edited text that ends in words of the next document.

The next document is found without a global sort in one task: ids alone are
range-partitioned to place cut points, texts are shuffled once to the slice
between two cut points, and the first document of each slice is also sent to the
slice before it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.llm.common import shared_table, shuffle_width, text_of
from crx.llm.ngram_join import BLOCK_ROWS, _column, _grouped
from crx.llm.shingles import MinHash, chunks, shingle_hashes
from crx.plans.session import ship_package

PERMUTATIONS = 128
SLICES_PER_PARTITION = 4


def fingerprint_values(texts: list[bytes], k: int, minhash: MinHash) -> np.ndarray:
    """One row of 16-bit values per text; equal texts have equal rows."""
    hashes, counts = shingle_hashes(texts, k)
    return (minhash.signatures(hashes, counts) & np.uint32(0xFFFF)).astype(np.uint16)


def jaccard_of(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two arrays of shingle hashes; two empty ones: 1."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _hex(values: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in values]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                 permutations: int = PERMUTATIONS) -> DataFrame:
    """One row per input row: doc_id, fingerprint. Null text counts as empty; texts
    without words share one fingerprint; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(permutations)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(_hex(fingerprint_values(texts[a:b], k, minhash)))],
                    names=["doc_id", "fingerprint"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def _digested(k: int, permutations: int) -> Callable:
    """For mapInArrow over (doc_id, text): the digest of the shingle set, null without
    words, and the fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(permutations)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                hashes, counts = shingle_hashes(texts[a:b], k)
                values = (minhash.signatures(hashes, counts) & np.uint32(0xFFFF)).astype(">u2")
                digests = [hashlib.blake2b(np.unique(x).tobytes(), digest_size=16).digest() if len(x) else None
                           for x in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(digests, pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())],
                    names=["doc_id", "digest", "fingerprint"])
    return run


def _shingled(k: int) -> Callable:
    """For mapInArrow over (node, fingerprint, text): text -> sorted shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                hashes, counts = shingle_hashes(texts[a:b], k)
                sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(2)], pa.array(sets, pa.binary())],
                                                 names=["node", "fingerprint", "shingles"])
    return run


def _similar_pairs(threshold: float, bands: int, permutations: int) -> Callable:
    """For mapInArrow over (band, value, b0, b1, block, node, fingerprint, shingles),
    sorted: all similar pairs across two blocks of a band value, or within one. A pair
    is compared in the first band it shares; of those, pairs whose fingerprints lie
    more than 5.6 standard errors below the threshold (once in 1e8 at it) are not."""
    least = threshold - 5.6 * math.sqrt(max(threshold * (1 - threshold), 0.0) / permutations)
    per = permutations // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = pa.int64()

        def typed(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in stream:
                id_type = batch.schema.field(5).type
                yield batch

        for (band, _, b0, b1), parts in _grouped(typed(batches), 4):
            block, nodes = np.array(_column(parts, 4)), _column(parts, 5)
            values = np.frombuffer(b"".join(_column(parts, 6)), dtype=">u2").reshape(len(nodes), -1)
            banded = values[:, :bands * per].reshape(len(nodes), bands, per)
            sets = [np.frombuffer(x, dtype=np.uint64) for x in _column(parts, 7)]
            left, right, scores = [], [], []
            for i in range(len(nodes)):
                if b0 != b1 and block[i] != b0:
                    continue
                others = np.flatnonzero(block == b1) if b0 != b1 else np.arange(i + 1, len(nodes))
                others = others[(values[others] == values[i]).mean(axis=1) >= least]
                others = others[(banded[others] == banded[i]).all(axis=2).argmax(axis=1) == band]
                for j in others:
                    score = jaccard_of(sets[i], sets[j])
                    if score >= threshold:
                        left.append(max(nodes[i], nodes[j]))
                        right.append(min(nodes[i], nodes[j]))
                        scores.append(score)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, id_type), pa.array(right, id_type), pa.array(scores)],
                                                 names=["left_id", "right_id", "jaccard"])
    return run


def similar_documents(docs: DataFrame, threshold: float = 0.8, bands: int = 32, id_col: str = "doc_id",
                      text_col: str = "text", k: int = 5, permutations: int = PERMUTATIONS) -> DataFrame:
    """Pairs (left_id, right_id, jaccard), left_id > right_id, of similar documents,
    Jaccard verified on the whole texts.

    Documents of equal shingle sets are represented by the smallest id among them.
    Every other one has one row with its representative, jaccard 1.0 (the
    membership), and every two representatives that share a signature band and reach
    the threshold have one row, jaccard below 1.0: so two documents are similar if
    their representatives are the same or a pair. Bands have permutations / bands
    values; a band value of many members is dealt by hash into blocks, all compared.
    Ids are taken to be unique; null texts are empty and pair with nothing."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    ship_package(docs.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]
    width = permutations // bands * 2
    signed = shared_table(rows.mapInArrow(_digested(k, permutations), f"doc_id {kind}, digest binary, fingerprint binary"), "similar-signed")
    nodes = shared_table(signed.filter(F.col("digest").isNotNull()).groupBy("digest")
                         .agg(F.min("doc_id").alias("node"), F.first("fingerprint").alias("fingerprint")), "similar-nodes")
    copies = (signed.join(nodes.select("digest", "node"), "digest").filter(F.col("doc_id") != F.col("node"))
              .select(F.col("doc_id").alias("left_id"), F.col("node").alias("right_id"), F.lit(1.0).alias("jaccard")))
    banded = nodes.select("node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.col("fingerprint").substr(i * width + 1, F.lit(width)))).alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n_blocks"),
                                                 F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    placed = shared_table(banded.join(shared, ["band", "value"]), "similar-bands")
    sets = shared_table(rows.join(nodes, F.col("doc_id") == F.col("node")).join(placed.select("node").distinct(), "node", "left_semi")
                        .select("node", "fingerprint", "text")
                        .mapInArrow(_shingled(k), f"node {kind}, fingerprint binary, shingles binary"), "similar-sets")
    blocked = (placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
               .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
               .select("band", "value", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block", "node")
               .join(sets, "node").select("band", "value", "b0", "b1", "block", "node", "fingerprint", "shingles")
               .repartition(shuffle_width(docs), "band", "value", "b0", "b1").sortWithinPartitions("band", "value", "b0", "b1"))
    pairs = blocked.mapInArrow(_similar_pairs(threshold, bands, permutations), f"left_id {kind}, right_id {kind}, jaccard double")
    return pairs.unionByName(copies)


def _compare(rows: list[tuple], k: int, minhash: MinHash, id_type: pa.DataType) -> pa.RecordBatch:
    """rows: (doc_id, text, next text); a next text is mostly the next row's text."""
    chars = [len(t) for _, t, _ in rows]
    edited = [(t[:n - n // 3] + nxt[:n // 3]).encode() for (_, t, nxt), n in zip(rows, chars, strict=True)]
    place: dict[int, int] = {}
    for _, t, nxt in rows:
        for x in (t, nxt):
            place.setdefault(id(x), len(place))
    plain = {id(x): x for _, t, nxt in rows for x in (t, nxt)}
    hashes, counts = shingle_hashes([plain[i].encode() for i in place], k)
    values = (minhash.signatures(hashes, counts) & np.uint32(0xFFFF)).astype(np.uint16)
    sets = np.split(hashes, np.cumsum(counts)[:-1])
    cut_hashes, cut_counts = shingle_hashes(edited, k)
    cut = (minhash.signatures(cut_hashes, cut_counts) & np.uint32(0xFFFF)).astype(np.uint16)
    cut_sets = np.split(cut_hashes, np.cumsum(cut_counts)[:-1])
    own, following = [place[id(t)] for _, t, _ in rows], [place[id(nxt)] for _, _, nxt in rows]
    mine = values[own]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], id_type), pa.array(chars, pa.int64()),
         pa.array([hashlib.sha256(x).hexdigest() for x in edited]), pa.array(_hex(mine)), pa.array(_hex(cut)),
         pa.array((mine == cut).mean(axis=1)), pa.array((mine == values[following]).mean(axis=1)),
         pa.array([jaccard_of(sets[i], x) for i, x in zip(own, cut_sets, strict=True)])],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited"])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                permutations: int = PERMUTATIONS) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, jaccard_edited.

    Documents are in descending order of (doc_id, text hash), null ids last; the
    next of the last is the first, of a single document itself. The edited text has
    the last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document. Null text is empty. Repeated rows follow one another. An
    empty table gives an empty result; other columns are ignored; ids are integers. `jaccard_edited`
    is the exact similarity of the text and the edited text."""
    slices = shuffle_width(docs) * SLICES_PER_PARTITION
    order_id = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), order_id.alias("k1"),
                        F.xxhash64(text_of(text_col)).alias("k2"))
    keys = shared_table(keyed.select("k1", "k2").repartitionByRange(slices, "k1", "k2")
                        .withColumn("part", F.spark_partition_id()), "fingerprint-keys")
    ends = sorted((r["top"]["k1"], r["top"]["k2"]) for r in  # one row per slice
                  keys.groupBy("part").agg(F.max(F.struct("k1", "k2")).alias("top")).collect())
    if not ends:
        ends = [(0, 0)]
    ends1, ends2 = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])

    @F.pandas_udf("slice int, top boolean")
    def slice_of(k1: pd.Series, k2: pd.Series) -> pd.DataFrame:
        """Slice i holds the keys up to ends[i]; top: the key is ends[i]."""
        a, b = k1.to_numpy(), k2.to_numpy()
        low, high = np.searchsorted(ends1, a, "left"), np.searchsorted(ends1, a, "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(ends2[low[i]:high[i]], b[i], "left")
        return pd.DataFrame({"slice": low.astype(np.int32), "top": (ends1[low] == a) & (ends2[low] == b)})

    placed = keyed.withColumn("p", slice_of("k1", "k2"))
    # in descending order slice i is followed by slice i - 1, the lowest by the highest
    here = F.struct(F.col("p.slice").alias("slice"), F.lit(0).alias("guest"))
    ahead = F.struct(F.pmod(F.col("p.slice") + 1, F.lit(len(ends))).alias("slice"), F.lit(1).alias("guest"))
    sent = placed.withColumn("to", F.explode(F.when(F.col("p.top"), F.array(here, ahead)).otherwise(F.array(here))))
    rows = (sent.select("doc_id", "text", "k1", "k2", F.col("to.slice").alias("at"), F.col("to.guest").alias("guest"))
            .repartition(shuffle_width(docs), "at")
            .sortWithinPartitions("at", "guest", F.desc("k1"), F.desc("k2"))
            .select("doc_id", "text", "at", "guest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(permutations)
        held = None  # the document whose next one has not come yet: (doc_id, text, slice)
        ready: list[tuple] = []
        size = 0
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text, at, guest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is not None and held[2] == at:
                    ready.append((held[0], held[1], text))
                    size += len(held[1])
                held = None if guest else (doc_id, text, at)
                if size > 1_000_000:
                    yield _compare(ready, k, minhash, id_type)
                    ready, size = [], 0
        if ready:
            yield _compare(ready, k, minhash, id_type)

    kind = dict(keyed.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double, jaccard_edited double")
