"""N-gram Jaccard join by a MinHash LSH forest, verified exactly.

1. Every text's set of word shingles gets a 128-bit digest and one key per tree of
   the forest, `depth` MinHash values long. Texts of equal shingle sets are one
   node from here on, however many documents share it.
2. A tree's keys, sorted, are a prefix trie; nodes below one prefix are candidates.
   Prefixes are shortened from the full depth until a pair at the threshold meets
   in some tree with the target recall.
3. Within a prefix, values of all trees estimate similarity, and nodes that may be
   similar (estimate above the threshold less SLACK) are chained. Chains of all
   prefixes make candidate clusters.
4. Within a cluster, all pairs of shingle sets are compared exactly, block against
   block, and only link counts and one chain of links leave the task, never the
   pairs. The chains make the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.llm.common import shared_table, shuffle_width, text_of
from crx.llm.components import components
from crx.llm.shingles import MinHash, chunks, shingle_hashes

TREES, DEPTH = 20, 6
SLACK = 0.2          # estimates from 120 values err by 0.2 at similarity 0.8 once in 1e7 pairs
BUCKET_ROWS = 4096   # nodes of one prefix compared in one task; more are dealt into several
BLOCK_ROWS = 512     # shingle sets of one side of an exact comparison


def prefix_depth(threshold: float, target_recall: float, trees: int, depth: int) -> int:
    """Longest prefix at which a pair at the threshold shares it in one of the trees
    with the target recall: 1 - (1 - threshold ** d) ** trees."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= target_recall:
            return d
    return 1


def _signed(k: int, trees: int, depth: int) -> Callable:
    """For mapInArrow over (doc_id, text, text_hash)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(trees * depth, seed=3)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                hashes, counts = shingle_hashes(texts[a:b], k)
                sets = np.split(hashes, np.cumsum(counts)[:-1])
                digests = [hashlib.blake2b(np.unique(s).tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = minhash.signatures(hashes, counts).astype(">u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(digests, pa.binary()),
                     pa.array([row.tobytes() for row in keys], pa.binary())],
                    names=["doc_id", "text_hash", "digest", "keys"])
    return run


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of a stream sorted by its first `n_keys` columns: (key, slices)."""
    key, parts = None, []
    for batch in batches:
        keys = list(zip(*[c.to_pylist() for c in batch.columns[:n_keys]], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if key is not None and keys[start] != key:
                    yield key, parts
                    parts = []
                key = keys[start]
                parts.append(batch.slice(start, i - start))
                start = i
    if key is not None:
        yield key, parts


def _column(parts: list[pa.RecordBatch], i: int) -> list:
    return [v for p in parts for v in p.column(i).to_pylist()]


def chains(values: np.ndarray, least: float) -> np.ndarray:
    """For rows of hash values: the row each is chained to, of those with at least
    the share `least` of equal values (itself: the first of its cluster)."""
    n = len(values)
    to = np.arange(n)
    free = np.ones(n, dtype=bool)
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        while queue:
            row = queue.pop()
            rest = np.flatnonzero(free)
            if not len(rest):
                return to
            near = rest[(values[rest] == values[row]).mean(axis=1) >= least]
            free[near] = False
            to[near] = first
            queue.extend(near.tolist())
    return to


def cover(values: np.ndarray, least: float) -> np.ndarray:
    """Rows such that every row has at least the share `least` in common with one."""
    left, leaders = np.arange(len(values)), []
    while len(left):
        leaders.append(left[0])
        left = left[(values[left] == values[left[0]]).mean(axis=1) < least]
    return np.array(leaders, dtype=np.int64)


def _sketch(keys: list[bytes]) -> np.ndarray:
    """The low bytes of the hash values: equal for unequal values once in 256."""
    return np.frombuffer(b"".join(keys), dtype=np.uint8).reshape(len(keys), -1)[:, 3::4]


def _bucket_edges(threshold: float) -> Callable:
    """For mapInArrow over (tree, prefix, deal, node, keys), sorted: edges (u, v) of
    nodes that may be similar; and with `leader` set, the nodes that stand for a
    bucket dealt into several tasks.

    Leaders: every node is within 1 - threshold of one. Jaccard distance is a
    metric, so similar nodes of two deals have leaders no further apart than three
    times that; leaders are chained at this distance in the next step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, prefix, deal), parts in _grouped(batches, 3):
            nodes = np.array(_column(parts, 3), dtype=np.int64)
            if len(nodes) == 1 and deal < 0:
                continue
            values = _sketch(_column(parts, 4))
            to = chains(values, threshold - SLACK)
            moved = np.flatnonzero(to != np.arange(len(to)))
            u, v, leader = [nodes[moved]], [nodes[to[moved]]], [np.zeros(len(moved), dtype=bool)]
            if deal >= 0:
                top = nodes[cover(values, threshold)]
                u, v, leader = [*u, top], [*v, top], [*leader, np.ones(len(top), dtype=bool)]
            n = sum(map(len, u))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * n, pa.int32()), pa.array([prefix] * n, pa.binary()), pa.array(np.concatenate(u)),
                     pa.array(np.concatenate(v)), pa.array(np.concatenate(leader))], names=["tree", "prefix", "u", "v", "leader"])
    return run


def _leader_edges(threshold: float) -> Callable:
    """For mapInArrow over (tree, prefix, node, keys), sorted: edges of leaders."""
    far = max(0.0, 1 - 3 * (1 - threshold) - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _grouped(batches, 2):
            nodes = np.array(_column(parts, 2), dtype=np.int64)
            to = chains(_sketch(_column(parts, 3)), far)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], names=["u", "v"])
    return run


def candidate_edges(nodes: DataFrame, threshold: float, depth: int, full_depth: int, trees: int) -> DataFrame:
    """Edges (u, v) that chain all nodes which may be similar. nodes: (node, keys)."""
    width = shuffle_width(nodes)
    at = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    prefix = F.col("keys").substr(F.col("tree") * (4 * full_depth) + 1, F.lit(4 * depth))
    placed = nodes.withColumn("tree", at).select("node", "tree", prefix.alias("prefix"))
    shared = placed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = placed.join(shared, ["tree", "prefix"])
    deals = F.ceil(F.col("n") / BUCKET_ROWS).cast("int")
    deal = F.when(deals > 1, F.pmod(F.xxhash64("node"), deals).cast("int")).otherwise(F.lit(-1))
    rows = (members.withColumn("deal", deal).join(nodes, "node")
            .select("tree", "prefix", "deal", "node", "keys")
            .repartition(width, "tree", "prefix", "deal").sortWithinPartitions("tree", "prefix", "deal"))
    found = shared_table(rows.mapInArrow(_bucket_edges(threshold), "tree int, prefix binary, u long, v long, leader boolean"),
                         "bucket-edges")
    leaders = (found.filter("leader").select("tree", "prefix", F.col("u").alias("node")).join(nodes, "node")
               .select("tree", "prefix", "node", "keys").repartition(width, "tree", "prefix")
               .sortWithinPartitions("tree", "prefix"))
    across = leaders.mapInArrow(_leader_edges(threshold), "u long, v long")
    return found.filter("not leader").select("u", "v").union(across)


def _shingle_sets(k: int) -> Callable:
    """For mapInArrow over (node, cluster, weight, text): text -> sorted shingle set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(3).cast(pa.binary()).to_pylist()]
            for a, b in chunks(texts):
                hashes, counts = shingle_hashes(texts[a:b], k)
                sets = [np.unique(s).tobytes() for s in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(3)], pa.array(sets, pa.binary())],
                                                 names=["node", "cluster", "weight", "shingles"])
    return run


def link_block(sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact links of one block pair: per set the summed weight of the sets it is
    linked with, and the set its chain of links leads to. side 0 and 1 are the two
    blocks (all pairs across); all of side 2 is one block (all pairs within)."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(inverse.max() + 1, dtype=bool)
    links, root = np.zeros(n, dtype=np.int64), np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        if side[i] == 1:
            continue
        own = inverse[starts[i]:starts[i] + sizes[i]]
        mark[own] = True
        both = np.add.reduceat(mark[inverse].astype(np.int32), starts)
        mark[own] = False
        near = both >= threshold * (sizes + sizes[i] - both) - 1e-9
        near[i] = False
        if side[i] == 0:
            near &= side == 1
        hits = np.flatnonzero(near)
        links[i] += weights[hits].sum()
        if side[i] == 0:
            links[hits] += weights[i]
        for j in hits:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return links, np.array([find(i) for i in range(n)], dtype=np.int64)


def _exact_links(threshold: float) -> Callable:
    """For mapInArrow over (cluster, b0, b1, block, node, weight, shingles), sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, b0, b1), parts in _grouped(batches, 3):
            nodes = np.array(_column(parts, 4), dtype=np.int64)
            block = np.array(_column(parts, 3))
            side = np.where(block == b0, 0, 1) if b0 != b1 else np.full(len(block), 2)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in _column(parts, 6)]
            links, to = link_block(sets, np.array(_column(parts, 5), dtype=np.int64), side, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to]), pa.array(links)], names=["u", "v", "links"])
    return run


def similarity_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, target_recall: float = 0.9999,
                       id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, text_hash, class_id, class_hash, n_links, n_copies.

    Similarity is the Jaccard similarity of the sets of `k` lower-cased words in a
    row (a shorter text is one shingle). Documents at `threshold` or more are
    linked; a class is what links connect, named after its smallest doc_id (and,
    of several texts with that id, the smallest text_hash). n_links counts the
    other documents a document is linked with, its copies included; n_copies the
    documents with the same shingle set. A text without words (null, empty, blank)
    is linked with nothing and is a class of its own. Repeated rows are copies of
    one another. Null ids sort first. An empty table gives an empty result; other
    columns are ignored."""
    text = F.lower(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    signed = shared_table(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
                          .mapInArrow(_signed(k, trees, depth), f"doc_id {kind}, text_hash long, digest binary, keys binary"), "signatures")
    nodes = shared_table(
        signed.filter(F.col("digest").isNotNull()).groupBy("digest")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("weight"), F.first("keys").alias("keys"))
        .select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.text_hash", "weight", "keys"), "nodes")

    d = prefix_depth(threshold, target_recall, trees, depth)
    clusters = shared_table(components(candidate_edges(nodes.select("node", "keys"), threshold, d, depth, trees)), "clusters")
    blocks = clusters.groupBy(F.col("root").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("n_blocks"))
    wanted = (clusters.select("node", F.col("root").alias("cluster"))
              .join(nodes.select("node", "doc_id", "text_hash", "weight"), "node"))
    texts = rows.withColumn("text_hash", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_hash"] == wanted["text_hash"])
    sets = shared_table(texts.join(wanted, same).dropDuplicates(["node"]).select("node", "cluster", "weight", "text")
                        .mapInArrow(_shingle_sets(k), "node long, cluster long, weight long, shingles binary"), "shingle-sets")
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    paired = (sets.join(blocks, "cluster").withColumn("block", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
              .select("cluster", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), "block",
                      "node", "weight", "shingles")
              .repartition(shuffle_width(docs), "cluster", "b0", "b1").sortWithinPartitions("cluster", "b0", "b1"))
    linked = shared_table(paired.mapInArrow(_exact_links(threshold), "u long, v long, links long"), "links")
    classes = components(linked.select("u", "v"))
    counts = linked.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    members = (nodes.select("node", "digest", "doc_id", "text_hash", "weight")
               .join(classes, "node", "left").join(counts, "node", "left")
               .withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0))))
    names = members.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("name"))
    final = members.join(names, "root").select("digest", F.col("name.doc_id").alias("class_id"), F.col("name.text_hash").alias("class_hash"),
                                               (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("n_copies"))
    worded = signed.filter(F.col("digest").isNotNull()).select("doc_id", "text_hash", "digest").join(final, "digest").drop("digest")
    wordless = signed.filter(F.col("digest").isNull()).select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("text_hash").alias("class_hash"),
        F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return worded.unionByName(wordless)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents with one left of each class, all columns kept: the one the class
    is named after. Where a row is repeated, one of the repeats stays."""
    classes = shared_table(similarity_classes(docs, id_col=id_col, text_col=text_col, **params), "classes")
    named = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    gone = classes.filter(~named).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("row_id"),
                       F.xxhash64(F.lower(text_of(text_col))).alias("row_hash"))
    on = F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash"))
    left = rows.join(gone, on, "left_anti")
    repeats = classes.filter(named & (F.col("n_copies") > 1)).groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeats.isEmpty():
        left = left.dropDuplicates(["row_id", "row_hash"])
    return left.select("row.*")
