"""Packing documents into fixed-length sequences by non-negative least squares.

Whole windows of a document fill a sequence each. What is left over is a tail
shorter than the window; the tails' length histogram (under `window` numbers)
goes to the driver, where shallow combinations of two or three lengths that fill
the window are enumerated, their repeat counts solved by non-negative least
squares against the histogram and rounded down, and the residual is packed
greedily, cutting a tail where no length fits. The plan consists of lots: "tails
of length r with ranks r0..r1 go to sequences base.., at this offset". Ranks are
distributed: a running count within each partition plus the counts of earlier
partitions, so a length that a third of the documents share is no hot group.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crx.llm.common import shared_table
from crx.llm.tokens import tokenised

TOKEN_SCHEMA = "part int, pos long, n_tokens long, tail_rank long, full_before long, ids binary"


class Lot(NamedTuple):
    tail: int          # length of the tail the piece is cut from
    rank0: int         # ranks [rank0, rank0 + count) of tails of that length
    count: int
    cut0: int          # the piece is [cut0, cut1) of the tail
    cut1: int
    sequence0: int     # rank0 goes to this sequence, the next rank to the next
    offset: int


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three of the lengths that sum to the window (0: unused)."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    rows = [np.array([[a, window - a, 0] for a in lengths if 2 * a <= window and have[window - a]], dtype=np.int64).reshape(-1, 3)]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        c = window - a - b
        ok = have[c]
        rows.append(np.column_stack([np.full(ok.sum(), a), b[ok], c[ok]]))
    return np.concatenate(rows)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative repeat counts x with A x near the histogram in least squares,
    where column j of A counts the lengths of combination j: multiplicative
    updates x <- x * (A'h) / (A'A x), which keep x non-negative."""
    size = len(histogram)

    def used(x: np.ndarray) -> np.ndarray:
        total = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=size)
        total[0] = 0
        return total

    goal = histogram.astype(float)
    goal[0] = 0
    top = goal[combos].sum(axis=1)
    x = np.full(len(combos), goal.sum() / max(1, 3 * len(combos)))
    for _ in range(steps):
        x *= top / np.maximum(used(x)[combos].sum(axis=1), 1e-9)
    return x


class _Stock:
    """Unpacked pieces by length, as runs of ranks of one tail length."""

    def __init__(self, histogram: np.ndarray):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # (tail, rank0, count, cut0)
        self.count: dict[int, int] = defaultdict(int)
        for tail, n in enumerate(histogram):
            if tail and n:
                self.put(tail, (tail, 0, int(n), 0))

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        self.runs[length].append(run)
        self.count[length] += run[2]

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        got = []
        self.count[length] -= n
        while n:
            tail, rank0, count, cut0 = self.runs[length].pop()
            k = min(n, count)
            got.append((tail, rank0, k, cut0))
            if k < count:
                self.runs[length].append((tail, rank0 + k, count - k, cut0))
            n -= k
        if not self.count[length]:
            del self.count[length], self.runs[length]
        return got


def plan_tails(histogram: np.ndarray, window: int) -> tuple[list[Lot], int]:
    """Lots for all tails, and the number of sequences they make."""
    stock, lots, made = _Stock(histogram), [], 0

    def place(lengths: list[int], n: int, cut_last: int = 0) -> None:
        nonlocal made
        offset = 0
        for i, length in enumerate(lengths):
            use = cut_last if cut_last and i == len(lengths) - 1 else length
            done = 0
            for tail, rank0, count, cut0 in stock.take(length, n):
                lots.append(Lot(tail, rank0, count, cut0, cut0 + use, made + done, offset))
                done += count
                if use < length:
                    stock.put(length - use, (tail, rank0, count, cut0 + use))
            offset += use
        made += n

    lengths = np.flatnonzero(histogram[:window])
    lengths = lengths[lengths > 0]
    combos = combinations(lengths, window)
    if len(combos):
        counts = solve_counts(combos, histogram[:window])
        for j in np.argsort(-counts, kind="stable"):
            n = int(counts[j] + 1e-6)
            if n < 1:
                break
            row = [int(v) for v in combos[j] if v]
            n = min([n, *[stock.count.get(v, 0) // row.count(v) for v in row]])
            if n:
                place(row, n)
    while stock.count:
        row, room = [max(stock.count)], window
        room -= row[0]
        while room:
            fits = [v for v in stock.count if v <= room and stock.count[v] > row.count(v)]
            if not fits:
                break
            row.append(max(fits))
            room -= row[-1]
        cut = 0
        if room:
            longer = [v for v in stock.count if v > room and stock.count[v] > row.count(v)]
            if longer:
                row.append(min(longer))
                cut = room
        place(row, min(stock.count[v] // row.count(v) for v in row), cut)
    return lots, made


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    ids (binary, little-endian unsigned 32-bit).

    A document is its ids followed by `end_id`; null or empty text is the end id
    alone. Each id lies in exactly one piece; sequences hold at most `window` ids
    and their pieces follow one another without a gap from offset 0. Repeated rows
    are packed each by itself. An empty table gives an empty result; other
    columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.spark_partition_id().alias("part"))
    id_type = dict(rows.dtypes)["doc_id"]
    tokens = shared_table(rows.mapInArrow(tokenised(tokenizer_path, end_id, window), f"doc_id {id_type}, {TOKEN_SCHEMA}"),
                          "pack-tokens")
    tail = F.col("n_tokens") % window
    per_part = tokens.groupBy("part", tail.alias("tail")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("n_tokens") / window)).alias("full"))
    per_part = shared_table(per_part, "pack-counts")
    histogram = np.zeros(window, dtype=np.int64)  # under `window` rows reach the driver
    for r in per_part.groupBy("tail").agg(F.sum("n").alias("n")).collect():
        histogram[r["tail"]] = r["n"]
    histogram[0] = 0
    lots, n_tail_sequences = plan_tails(histogram, window)

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    full_offsets = (per_part.groupBy("part").agg(F.sum("full").alias("full"))  # one row per partition
                    .select("part", (F.coalesce(F.sum("full").over(earlier), F.lit(0)) + n_tail_sequences).alias("full0")))
    same_tail = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tail_offsets = per_part.select("part", "tail", F.coalesce(F.sum("n").over(same_tail), F.lit(0)).alias("rank0"))
    plan = spark.createDataFrame(
        lots, "tail long, from_rank long, count long, cut0 long, cut1 long, sequence0 long, offset long") if lots else \
        spark.createDataFrame([], "tail long, from_rank long, count long, cut0 long, cut1 long, sequence0 long, offset long")

    wholes = (tokens.filter(F.col("n_tokens") >= window).join(full_offsets, "part")
              .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_tokens") / window) - 1)))
              .select("doc_id", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                      F.col("n_tokens").alias("doc_tokens"), (F.col("full0") + F.col("full_before") + F.col("k")).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset"),
                      F.col("ids").substr((F.col("k") * window * 4 + 1).cast("int"), F.lit(window * 4)).alias("ids")))
    tails = (tokens.filter(tail > 0)
             .select("doc_id", "part", "n_tokens", tail.alias("tail"), "tail_rank",
                     F.col("ids").substr(((F.col("n_tokens") - tail) * 4 + 1).cast("int"), (tail * 4).cast("int")).alias("ids"))
             .join(tail_offsets, ["part", "tail"])
             .withColumn("rank", F.col("rank0") + F.col("tail_rank")).drop("rank0", "part"))
    rank_in_lot = F.col("rank") - F.col("from_rank")
    pieces = (tails.join(F.broadcast(plan), "tail")  # a few thousand lots, whatever the input
              .filter((rank_in_lot >= 0) & (rank_in_lot < F.col("count")))
              .select("doc_id", (F.col("n_tokens") - F.col("tail") + F.col("cut0")).alias("start"),
                      (F.col("cut1") - F.col("cut0")).alias("length"), F.col("n_tokens").alias("doc_tokens"),
                      (F.col("sequence0") + rank_in_lot).alias("sequence_id"), "offset",
                      F.col("ids").substr((F.col("cut0") * 4 + 1).cast("int"), ((F.col("cut1") - F.col("cut0")) * 4).cast("int")).alias("ids")))
    return wholes.unionByName(pieces)
