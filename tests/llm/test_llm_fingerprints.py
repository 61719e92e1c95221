"""Fingerprints against plain Python sets."""

import hashlib

import numpy as np
import pytest

from crx.llm.fingerprints import edit_report, fingerprints, similar_documents
from crx.llm.q_text import op10_fingerprints
from crx.llm.shingles import MinHash, shingle_hashes

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs):
    order = sorted(docs, reverse=True)
    out = {}
    for i, d in enumerate(order):
        t, nxt = docs[d], docs[order[(i + 1) % len(order)]]
        m = len(t) // 3
        edited = t[:len(t) - m] + nxt[:m]
        a = shingle_set(t)
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(a, shingle_set(edited)), jaccard(a, shingle_set(nxt)))
    return out


def test_shingles_are_word_sets():
    texts = ["", "a", "a b c", "a b c d e f", " a  b\tc\nd e\r\nf ", "x" * 3000 + " é ü 日本 q r s", "a b c d e"]
    hashes, counts = shingle_hashes([t.encode() for t in texts])
    sets = np.split(hashes, np.cumsum(counts)[:-1])
    want = [shingle_set(t) for t in texts]
    assert [len(np.unique(s)) for s in sets] == [len(w) for w in want]
    for a, x in zip(sets, want, strict=True):
        for b, y in zip(sets, want, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)
    assert (MinHash(8).signatures(hashes, counts)[0] == 0xFFFFFFFF).all()


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = expected(docs)
    rows = {r.doc_id: r for r in op10_fingerprints(spark, SMALL).collect()}
    assert set(rows) == set(want)
    by_text = {}
    for d, (n, sha, near_edited, near_next) in want.items():
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.jaccard_edited == pytest.approx(near_edited)
        assert abs(r.near_edited - near_edited) < 0.25 and abs(r.near_next - near_next) < 0.25
        assert by_text.setdefault(docs[d], r.fingerprint) == r.fingerprint
    assert np.mean([abs(rows[d].near_edited - w[2]) for d, w in want.items()]) < 0.05


def test_odd_rows(spark):
    rows = [(3, None, 1), (2, "", 1), (2, "", 1), (None, "only words here now five", 2), (9, "日本 " * 50, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    out = edit_report(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in out) == \
        [(False, 2, 0), (False, 2, 0), (False, 3, 0), (False, 9, 150), (True, 0, 24)]
    nine = next(r for r in out if r.doc_id == 9)
    assert nine.edited_sha256 == hashlib.sha256(("日本 " * 50)[:100].encode()).hexdigest()
    last = next(r for r in out if r.doc_id is None)
    t = "only words here now five"
    assert last.edited_sha256 == hashlib.sha256((t[:16] + ("日本 " * 50)[:8]).encode()).hexdigest()
    assert edit_report(df.limit(0)).count() == 0
    single = edit_report(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    assert single[0].near_next == 1.0


def test_similar_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base), (3, base.replace("w7 ", "x ")), (4, " ".join(f"v{i}" for i in range(200))), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.left_id, r.right_id): r.jaccard for r in similar_documents(df).collect()}
    assert got[(2, 1)] == 1.0 and got[(3, 1)] == pytest.approx(jaccard(shingle_set(base), shingle_set(rows[2][1])))
    assert all(4 not in p and 5 not in p and 6 not in p for p in got)
    assert fingerprints(df).select("doc_id").count() == 6


@pytest.mark.parametrize("block_rows", [512, 4])
def test_similar_documents_equal_all_pairs(spark, monkeypatch, block_rows):
    """Dissimilar documents share a passage, and families of near copies lie among
    them; none of the pairs depends on who is first in a band."""
    import random

    from crx.llm import fingerprints as module
    monkeypatch.setattr(module, "BLOCK_ROWS", block_rows)
    rng = random.Random(6)
    own = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passage = own(120)
    texts = [" ".join(passage + own(80)) for _ in range(40)]
    for _ in range(8):
        base = passage + own(150)
        texts += [" ".join(base[:i] + own(1) + base[i + 1:]) for i in rng.sample(range(len(base)), 5)]
    texts += [texts[50], texts[50].replace(" ", "  "), texts[3], "", None]
    rng.shuffle(texts)
    sets = [frozenset(shingle_set(t or "")) for t in texts]
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(x, i)
    want = {(i, first[x]): 1.0 for i, x in enumerate(sets) if x and first[x] != i}
    heads = [i for x, i in first.items() if x]
    want |= {(a, b): jaccard(sets[a], sets[b]) for a in heads for b in heads if a > b and jaccard(sets[a], sets[b]) >= 0.8}
    rows = similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(want) and len(want) > 60
    assert {(r.left_id, r.right_id): r.jaccard for r in rows} == pytest.approx(want)
