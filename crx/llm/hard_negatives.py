"""Hard negatives from embeddings, by segment summaries.

A vector is cut into equal segments, and each segment's mean and deviation (norm of
what is left without the mean) are kept. For two vectors the product of the means
times the length, plus or minus the product of the deviations, bounds a segment's
share of the inner product; summed, the segments bound the score. Anchors meet the
rows in blocks. In a block the bounds of few long segments are tried first, those of
more and shorter ones on what is left, and only rows and anchors that some bound lets
through are scored, exactly.

Rows are dealt to blocks by a hash of their id and stay there; anchors are sent to
every block, so a task holds one block and one batch of anchors, whatever the label
or the copies of a vector. Only the best few of each anchor leave a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crx.llm.common import shared_table, shuffle_width
from crx.plans.session import ship_package

SCALE = 256
BLOCK_ROWS = 32_768
LEAST_BLOCK_ROWS = 256  # blocks are not made smaller than this to fill more tasks
STEP_ROWS = 4_096  # rows of a block that are held against a batch of anchors at once
SEGMENTS = (4, 16)  # segments per vector, level by level
FOUND = "anchor_id long, window long, id long, score long"


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """id, label, x (array of floor(256 * component)) of the rows that take part: id,
    label and vector are there, and every component is a finite number. Of rows with one
    id the smallest (label, x) stays."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    clean = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    clean = clean.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return (clean.select("id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("x"))
            .groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("id", "row.*"))


def segment_summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean * sqrt(length), deviation) of every segment, so that plain products of both
    bound a segment's inner product. The last segment may be shorter."""
    length = -(-x.shape[1] // segments)
    full = np.zeros((len(x), segments * length))
    full[:, :x.shape[1]] = x
    sizes = np.clip(x.shape[1] - length * np.arange(segments), 1, length)
    parts = full.reshape(len(x), segments, length)
    mean = parts.sum(axis=2) / sizes
    rest = np.maximum((parts ** 2).sum(axis=2) - sizes * mean ** 2, 0)
    return mean * np.sqrt(sizes), np.sqrt(rest)


def exact_type(largest: int, dims: int) -> type:
    """The numbers in which inner products of such vectors are exact."""
    bound = largest * largest * dims
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Block:
    """Rows sorted by label, with their summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, largest: int):
        self.ids, self.labels = ids, labels
        self.x = x.astype(exact_type(largest, x.shape[1]))
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.levels = [np.hstack(segment_summary(x, s)) for s in SEGMENTS if s < x.shape[1]]

    def ranges(self, label: int, same: bool) -> list[tuple[int, int]]:
        """The rows of the label, or all the others, in steps."""
        a, b = np.searchsorted(self.labels, label), np.searchsorted(self.labels, label, side="right")
        spans = [(a, b)] if same else [(0, a), (b, len(self.ids))]
        return [(i, min(i + STEP_ROWS, end)) for start, end in spans for i in range(start, end, STEP_ROWS)]


def within(anchors: Block, rows: Block, pick: np.ndarray, start: int, end: int,
           least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the pairs of `pick` and rows [start, end) whose score lies
    in [least, most] of the anchor."""
    here, there = np.arange(len(pick)), np.arange(start, end)
    slack = 1 + 1e-9 * anchors.norm[pick].max(initial=0) * rows.norm[start:end].max(initial=0)
    for mine, theirs in zip(anchors.levels, rows.levels, strict=True):
        half = mine.shape[1] // 2
        ours = mine[pick[here]]
        signed = ours * np.where(np.arange(2 * half) < half, 1.0, -1.0)
        summary = theirs[there].T
        alive = ((ours @ summary) + slack >= least[here, None]) & ((signed @ summary) - slack <= most[here, None])
        here, there = here[alive.any(axis=1)], there[alive.any(axis=0)]
        if not len(here) or not len(there):
            return here[:0], there[:0], np.empty(0)
    score = anchors.x[pick[here]] @ rows.x[there].T
    a, r = np.nonzero((score >= least[here, None]) & (score <= most[here, None]))
    return here[a], there[r], score[a, r]


def keep_first(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of each owner's first k by score descending, then id."""
    order = np.lexsort((ids, -score, owner))
    sorted_owner = owner[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner)
    return order[rank < k]


def search(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Iterator[tuple]:
    """(anchor, window, row, score): for each anchor and window the first k rows of its
    own label without itself (`same`), or of other labels, with a score in [low, high]
    (anchors x windows). Rows found so far raise what later steps must reach."""
    windows = low.shape[1]
    for label in np.unique(anchors.labels):
        pick = np.flatnonzero(anchors.labels == label)
        lo, hi = low[pick], high[pick]
        need = lo.copy()
        held = [tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, rows.x.dtype)) for _ in range(windows)]
        for start, end in rows.ranges(label, same):
            a, r, score = within(anchors, rows, pick, start, end, need.min(axis=1), hi.max(axis=1))
            if same:
                other = rows.ids[r] != anchors.ids[pick[a]]
                a, r, score = a[other], r[other], score[other]
            for w in range(windows):
                ok = (score >= need[a, w]) & (score <= hi[a, w])
                own, row, points = (np.concatenate(x) for x in zip(held[w], (a[ok], r[ok], score[ok]), strict=True))
                first = keep_first(own, points, rows.ids[row], k)
                own, row, points = held[w] = own[first], row[first], points[first]
                last = np.flatnonzero(np.bincount(own, minlength=len(pick)) >= k)
                if len(last):  # owners are in order: the k-th of each full one
                    need[last, w] = np.maximum(need[last, w], points[np.searchsorted(own, last, side="right") - 1])
        for w in range(windows):
            own, row, points = held[w]
            yield pick[own], np.full(len(own), w), row, points


def score_window(score: int) -> tuple[int, int]:
    """Least and greatest n with 50 * score <= 100 * n <= 95 * score."""
    return -(-50 * score // 100), 95 * score // 100


def _searched(k: int, same: bool, largest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (block, is_anchor, id, label, x, targets), sorted: the rows of
    a block come first, then anchors, held against it batch by batch."""
    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        return ids, labels, batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def bounds(targets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        if same:
            return np.full((len(targets), 1), -np.inf), np.full((len(targets), 1), np.inf)
        width = max(len(t) for t in targets)
        pairs = [[score_window(s) for s in t] + [(1, 0)] * (width - len(t)) for t in targets]
        both = np.array(pairs, dtype=np.float64 if exact_type(largest, 1) is not object else object)
        return both[..., 0], both[..., 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, rows = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                piece, block = batch.slice(start, end - start), int(keys[start]) // 2
                if block != number:
                    number, parts, rows = block, [], None
                if not keys[start] % 2:
                    parts.append(columns(piece))
                    continue
                if not parts:
                    continue  # a block without rows
                rows = rows or Block(*(np.concatenate(c) for c in zip(*parts, strict=True)), largest)
                anchors = Block(*columns(piece), largest)
                for a, w, r, score in search(anchors, rows, *bounds(piece.column(5).to_pylist()), k, same):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (anchors.ids[a], w, rows.ids[r], _as_long(score))],
                        names=["anchor_id", "window", "id", "score"])
    return run


def _as_long(score: np.ndarray) -> np.ndarray:
    if score.dtype == object:
        return np.array([min(max(int(s), -1 << 63), (1 << 63) - 1) for s in score], dtype=np.int64)
    return score.astype(np.int64)


def best_rows(rows: DataFrame, anchors: DataFrame, blocks: int, largest: int, k: int, same: bool) -> DataFrame:
    """anchor_id, window, id, score, rank: the first k of all blocks. `rows` has block,
    id, label, x; `anchors` id, label, x, targets (array of scores; a window for each)."""
    none = F.lit(None).cast("array<long>")
    sent = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("is_anchor"), "id", "label", "x", "targets")
    met = (rows.select("block", F.lit(0).alias("is_anchor"), "id", "label", "x", none.alias("targets")).union(sent)
           .repartition(blocks, "block").sortWithinPartitions("block", "is_anchor", "label", "id"))
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return (met.mapInArrow(_searched(k, same, largest), FOUND)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def hard_negatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label",
                   anchor: Column | None = None, positives: int = 5, negatives: int = 3,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 * x); a score is the integer inner product. An anchor
    (a row for which `anchor` holds; by default ids divisible by 50) has as positives its
    first `positives` other rows of the same label, by score, ties by id. For each, the
    first `negatives` rows of other labels with 50 p <= 100 n <= 95 p are returned.

    Rows with a null id, label or vector, or a null or non-finite component take no
    part; of rows sharing an id the one of smallest (label, vector) does. A shorter vector
    counts as padded with zeros, an empty one scores 0. Anchors without positives, or
    positives without a row in their range, give no row. Scores beyond a long are cut to
    its range. An empty table gives an empty result; other columns are ignored."""
    spark = rows.sparkSession
    ship_package(spark)
    label = F.col(label) if isinstance(label, str) else label
    vectors = shared_table(whole_vectors(rows, id_col, vector_col, label), "vectors")
    n, dims, largest = vectors.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()
    dims, largest = max(dims or 0, 1), int(largest or 0)
    blocks = max(-(-n // block_rows), min(shuffle_width(rows), n // LEAST_BLOCK_ROWS), 1)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    dealt = shared_table(vectors.select("id", "label", padded.cast("array<int>" if largest < 1 << 31 else "array<long>").alias("x"),
                                        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")), "vector-blocks")
    anchors = dealt.filter(F.col("id") % 50 == 0 if anchor is None else anchor).select("id", "label", "x")
    own = best_rows(dealt, anchors.withColumn("targets", F.lit(None).cast("array<long>")), blocks, largest, positives, True)
    own = shared_table(own.select("anchor_id", "rank", "id", "score"), "positives")
    targets = (own.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found"))
               .select("id", F.transform("found", lambda f: f["score"]).alias("targets")))
    other = best_rows(dealt, anchors.join(targets, "id"), blocks, largest, negatives, False)
    return (other.withColumn("place", F.col("window") + 1)
            .join(own.select("anchor_id", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
                  ["anchor_id", "place"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
