"""The near-duplicate join against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from crx.llm import ngram_join
from crx.llm.components import components
from crx.llm.ngram_join import chains, cover, drop_near_copies, link_block, prefix_depth, similarity_classes
from crx.llm.q_text import op1_ngram_join

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, t=0.8):
    """docs: list of (id, text) -> {id: (class, links, copies)}, unique ids."""
    sets = [shingle_set(x) for _, x in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links, copies = [0] * len(docs), [1] * len(docs)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and both >= t * (len(a) + len(b) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                if a == b:
                    copies[i] += 1
                    copies[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (least[find(i)], links[i], copies[i]) for i, (d, _) in enumerate(docs)}


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in op1_ngram_join(spark, SMALL).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


@pytest.mark.parametrize("bucket_rows,block_rows", [(4096, 512), (8, 5)])
def test_large_group_of_near_copies(spark, monkeypatch, bucket_rows, block_rows):
    monkeypatch.setattr(ngram_join, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(f"{i}v{rng.randrange(9999)}" for _ in range(60)) + " " + " ".join(base[:20])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in similarity_classes(df).collect()}
    assert got == want


def test_odd_rows_and_filter(spark):
    long = " ".join(f"w{i % 977}a{i}" for i in range(40_000))
    rows = [(1, None, "a", "k"), (2, "", "b", "k"), (3, "One two", "c", "k"), (4, "one  TWO", "d", "k"), (5, long, "e", "k"),
            (5, long, "e", "k"), (6, long + " end", "f", "k"), (None, "a b c d e f", "g", "k"), (7, "\n \t", "h", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string, node string")
    got = sorted(((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in similarity_classes(df).collect()))
    assert got == [(0, 0, 0, 1), (1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 1, 2), (4, 3, 1, 2), (5, 5, 2, 2), (5, 5, 2, 2), (6, 5, 2, 1), (7, 7, 0, 1)]
    left = drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r.class_id for r in left.collect()) == ["a", "b", "c", "e", "g", "h"]
    assert similarity_classes(df.limit(0)).count() == 0
    assert drop_near_copies(df.limit(0)).count() == 0


def test_helpers():
    assert prefix_depth(0.8, 0.9999, 20, 6) == 4
    assert prefix_depth(0.99, 0.9, 20, 6) == 6
    v = np.array([[1, 1, 1, 1], [1, 1, 1, 2], [9, 9, 9, 9], [1, 1, 2, 2]], dtype=np.uint8)
    assert chains(v, 0.75).tolist() == [0, 0, 2, 0]
    assert cover(v, 0.75).tolist() == [0, 2, 3]
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    links, to = link_block(sets, np.array([1, 3, 1]), np.full(3, 2), 0.8)
    assert links.tolist() == [3, 1, 0] and to.tolist() == [0, 0, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(7, 3), (3, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200}
    assert components(df.limit(0)).count() == 0
