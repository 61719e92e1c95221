"""Hard negatives, suffix dedup and source divergence against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from crx.llm import hard_negatives as HN
from crx.llm import suffix_dedup as SD
from crx.llm.divergence import divergence_report, skyband
from crx.llm.q_search import op12_suffix_dedup
from crx.llm.suffixes import CORE, merged_spans, runs_of_windows

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


# ---------------------------------------------------------------- op11

def plain_negatives(rows, positives=5, negatives=3):
    clean = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = [math.floor(256 * float(np.float32(c))) for c in v]
        clean[i] = min(clean.get(i, (label, x)), (label, x))
    out = []
    score = lambda a, b: sum(p * q for p, q in zip(clean[a][1], clean[b][1]))
    for a in clean:
        if a % 50:
            continue
        ranked = sorted((b for b in clean if b != a), key=lambda b: (-score(a, b), b))
        for p in [b for b in ranked if clean[b][0] == clean[a][0]][:positives]:
            s = score(a, p)
            found = [b for b in ranked if clean[b][0] != clean[a][0] and 50 * s <= 100 * score(a, b) <= 95 * s][:negatives]
            out += [(a, p, r + 1, b, s, score(a, b)) for r, b in enumerate(found)]
    return sorted(out)


def found_negatives(df, **params):
    return sorted(tuple(r) for r in HN.hard_negatives(df, **params).collect())


@pytest.mark.parametrize("blocks", [40, 1_000])
def test_hard_negatives_equal_the_plain_rule(spark, blocks):
    """Ties, copies, nulls, non-finite components, shorter and empty vectors, repeated
    and clashing ids, negative and zero scores; blocks of any size."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, rng.random()]) for _ in range(9)], rng.randrange(4)) for i in range(400)]
    rows += [(i, rows[0][1], i % 3) for i in range(400, 440)]  # copies of the first anchor's vector
    rows += [(450, [0.5] * 9, None), (500, None, 1), (550, [0.1, None] + [0.0] * 7, 1), (551, [float("nan")] + [0.0] * 8, 1), (552, [float("inf")] * 9, 1), (None, [1.0] * 9, 1),
             (600, [1.0, 0.5], 2), (601, [], 2), (602, [0.0] * 9, 2), (650, [0.0] * 9, 1), (1, rows[1][1], rows[1][2]), (2, [9.0] * 9, 0), (700, [0.3] * 9, 77)]
    df = spark.createDataFrame([(*r, "k") for r in rows], VECTORS + ", score string")
    got = found_negatives(df, block_rows=blocks)
    assert got == plain_negatives(rows) and got
    assert HN.hard_negatives(df.limit(0)).count() == 0
    only = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], VECTORS)
    assert found_negatives(only) == []


def test_hard_negatives_of_large_components(spark):
    """Products beyond float32 and beyond float64 stay exact."""
    rng = random.Random(6)
    for size, kind in ((60, np.float64), (1e6, object)):
        rows = [(i, [rng.choice([-1, 1, 0.5]) * rng.random() * size for _ in range(5)], rng.randrange(3)) for i in range(120)]
        assert HN.exact_type(int(256 * size), 5) is kind
        df = spark.createDataFrame(rows, VECTORS)
        assert found_negatives(df, block_rows=50) == plain_negatives(rows)


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 80, (300, 13)) + rng.normal(0, 60, (300, 1)))
    for segments in (1, 2, 4, 5, 13):
        mean, dev = HN.segment_summary(x, segments)
        exact = x @ x.T
        assert (exact <= mean @ mean.T + dev @ dev.T + 1e-6).all() and (exact >= mean @ mean.T - dev @ dev.T - 1e-6).all()
    block = HN.Block(np.arange(300), np.sort(rng.integers(0, 3, 300)), x.astype(np.int64), 400)
    least, most = np.full(300, 20_000.0), np.full(300, 60_000.0)
    a, r, score = HN.within(block, block, np.arange(300), 50, 250, least, most)
    want = {(i, j) for i in range(300) for j in range(50, 250) if 20_000 <= exact[i, j] <= 60_000}
    assert set(zip(a.tolist(), r.tolist())) == want and (score == exact[a, r]).all()


def test_bounds_leave_far_rows_unscored(monkeypatch):
    """Rows that the summaries exclude are not scored: clusters along few segments."""
    rng = np.random.default_rng(2)
    centre = np.repeat(np.eye(8), 8, axis=1) * 200
    x = np.floor(np.repeat(centre, 512, axis=0) + rng.normal(0, 3, (4096, 64))).astype(np.int64)
    rows = HN.Block(np.arange(4096), np.zeros(4096, dtype=np.int64), x, 256)
    anchors = HN.Block(np.arange(4), np.zeros(4, dtype=np.int64), x[:4], 256)
    scored = []
    product = HN.Block.__getattribute__

    class Counted(np.ndarray):
        def __matmul__(self, other):
            scored.append(other.shape[1])
            return np.asarray(self) @ np.asarray(other)
    anchors.x = anchors.x.view(Counted)
    a, _, _ = HN.within(anchors, rows, np.arange(4), 0, 4096, np.full(4, 100_000.0), np.full(4, np.inf))
    assert product and sum(scored) <= 512 and len(a) == 4 * 512


# ---------------------------------------------------------------- op12

def plain_repeats(rows, length=50):
    """doc_id -> results of its rows, by the definition, byte by byte."""
    by_id, seen, out = defaultdict(list), {}, defaultdict(list)
    for i, t in rows:
        by_id[i].append((t or "").encode())
    for i in sorted(by_id, key=lambda i: (i is None, i)):
        for b in by_id[i]:
            mark = bytearray(len(b))
            for p in range(len(b) - length + 1):
                if i is not None and b[p:p + length] in seen:
                    mark[p:p + length] = b"\1" * length
            runs = [x for x in bytes(mark).split(b"\0") if x]
            out[i].append((len(b), sum(mark), len(runs), hashlib.sha256(bytes(c for c, m in zip(b, mark) if not m)).hexdigest()))
        for b in by_id[i]:
            for p in range(len(b) - length + 1):
                seen.setdefault(b[p:p + length], i)
    return {i: sorted(v) for i, v in out.items()}


def found_repeats(df, **params):
    out = defaultdict(list)
    for r in SD.remove_repeats(df, **params).collect():
        out[r.doc_id].append((r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def test_suffix_query_equals_the_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = plain_repeats([(r.doc_id, r.text) for r in docs])
    got = op12_suffix_dedup(spark, SMALL).collect()
    assert len(got) == len(docs)
    assert all([(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] == want[r.doc_id] for r in got) and any(r.n_removed for r in got)


def _passages(seed, n):
    rng = random.Random(seed)
    words = ["ab", "ü", "lorem ", "x" * 7, "\n", "aa", "data ", "🙂", "long-winded "]
    text = lambda k: "".join(rng.choice(words) for _ in range(k))
    shared = [text(k) for k in (5, 12, 13, 30, 80, 200)] + ["a" * 49, "a" * 50, "a" * 300, "ab" * 60]
    rows = []
    for _ in range(n):
        t = "".join(rng.choice([text(rng.randrange(25)), rng.choice(shared), rng.choice(shared)[rng.randrange(20):]]) for _ in range(rng.randrange(6)))
        rows.append((rng.randrange(-5, n), t))
    return rows


@pytest.mark.parametrize(("shares", "pack", "hot"), [((1.0,), 1 << 20, 4096), ((0.25, 0.25, 0.5), 3_000, 4096), ((0.1,) * 10, 500, 3), ((0.5, 0.5), 2_000, 0)])
def test_suffix_dedup_on_odd_texts(spark, shares, pack, hot):
    """Passages cut at any place, runs of one letter, multi-byte letters, repeated ids and
    rows, null and negative ids, null texts, one long text; any batches, packs, hot cores."""
    rows = _passages(len(shares), 220) + [(3, None), (4, ""), (None, "a" * 200), (None, None), (7, "a" * 200), (7, "a" * 200), (900, "z" * 30_000 + "a" * 60), (901, "z" * 20_000), (-9, "ab" * 40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, pack int")
    assert found_repeats(df, shares=shares, pack_bytes=pack, hot_rows=hot) == plain_repeats(rows)


def test_suffix_dedup_of_empty_and_short_tables(spark):
    df = spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string")
    assert found_repeats(df) == plain_repeats([(1, "short"), (2, "short")])
    assert SD.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        SD.remove_repeats(df, length=20)
    for length in (32, 64):
        rows = _passages(9, 80)
        assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, pack_bytes=800) == plain_repeats(rows, length)


def test_levels_merge_geometrically():
    """Which levels a batch merges with, and what it leaves, without running anything."""
    sizes = []

    class Fake:
        def __getattr__(self, name):
            return lambda *a, **k: self
    family = SD.SuffixFamily(50, 4)
    import crx.llm.suffix_dedup as module
    keep, module.shared_table = module.shared_table, lambda df, name: df
    functions, module.F = module.F, Fake()
    try:
        for _ in range(8):
            family.add(Fake(), 1)
            sizes.append([n for _, n in family.levels])
    finally:
        module.shared_table, module.F = keep, functions
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1], [8]]


def test_equal_windows_have_equal_samples():
    """Every window lies in one run, and its sample's place in it depends on its bytes."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.choice([0, 10, 49, 50, 51, 400]))) for _ in range(30)] + [b"a" * 200, b"ab" * 90, bytes(rng.randrange(256) for _ in range(150_000))]
    texts.append(texts[-1][1_000:140_000])
    data, sizes = np.frombuffer(b"".join(texts), dtype=np.uint8), np.array([len(t) for t in texts])
    first, last, place = runs_of_windows(data, sizes, 50)
    ends = np.cumsum(sizes)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert sorted(windows.tolist()) == [p for e, n in zip(ends, sizes) for p in range(e - n, e - 49)]
    offset = {}
    for a, b, p in zip(first.tolist(), last.tolist(), place.tolist()):
        for w in range(a, b + 1):
            assert w <= p <= w + 50 - CORE
            assert offset.setdefault(data[w:w + 50].tobytes(), p - w) == p - w
    start, end = merged_spans(np.array([5, 1, 9, 20, 3]), np.array([9, 2, 12, 30, 6]))
    assert start.tolist() == [1, 3, 20] and end.tolist() == [2, 12, 30]


# ---------------------------------------------------------------- op13

def plain_divergence(rows, min_docs=10, top=10):
    import re
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = term.findall((text or "").translate(lower))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: {t: count[lang, s][t] for t in kept} for g, s in groups if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s))
            out += [(lang, s, "pair", o, -v, r + 1) for r, (v, _, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, r + 1) for r, (v, _, t) in enumerate(terms)]
    return sorted(out)


def test_divergence_equals_the_plain_rule(spark):
    """Null texts, langs and sources, groups without terms, one source alone, ties, words
    of other scripts, a very long text, clashing columns."""
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("Ab", "ß", "x", "été", "日本", "zZ") for b in ("", "a", "É", "m", "n", "o")]
    rows = []
    for _ in range(400):
        source = rng.choice(["s1", "s1", "s1", "s2", "S3", "", None])
        own = words[: 12 if source == "s1" else 36]
        rows.append((" ".join(rng.choice(own) + rng.choice(["", ",", "1", "\t"]) for _ in range(rng.randrange(30))), rng.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "empty"), ("123 !?", "fr", "a"), ("nur eines", "fr", "b"), ("solo", "it", "one"), ("Ab " * 60_000, "en", "s2"), ("", None, None)]
    df = spark.createDataFrame([(i, *r, "t", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, value int")
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence_report(df).collect())
    assert got == plain_divergence(rows)
    assert sorted(tuple(r)[:5] + (r.rank,) for r in divergence_report(df, min_docs=1, top=3).collect()) == plain_divergence(rows, 1, 3)
    assert divergence_report(df.limit(0)).count() == 0


def test_skyband_keeps_points_with_few_dominators():
    rng = np.random.default_rng(3)
    for n, k, spread in ((1, 1, 5), (700, 3, 12), (1500, 10, 1000), (900, 1, 4)):
        count, lang = rng.integers(1, spread, n), rng.integers(1, spread, n)
        rank = rng.permutation(n)
        want = [i for i in range(n) if ((count >= count[i]) & (lang <= lang[i]) & (rank < rank[i])).sum() < k]
        assert sorted(skyband(count, lang, rank, k).tolist()) == want
