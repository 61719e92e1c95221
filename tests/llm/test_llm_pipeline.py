"""The corpus pipeline on the smallest tables: each stage against a plain version of it."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, the stages written and reread as the driver does."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(("documents", docs.columns, docs.collect()))
    for i, (name, fn) in enumerate(P.STAGES):
        df = fn(spark, docs, SMALL)
        df.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs.columns, docs.collect()))
    return out


def test_columns_stay(stages):
    assert [n for n, _, _ in stages[1:]] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    assert all(c == stages[0][1] for _, c, _ in stages[1:-1])


def test_toxicity_stage(stages, spark):
    before, after = {r.doc_id: r for r in stages[0][2]}, {r.doc_id: r for r in stages[1][2]}
    assert all(before[d] == r for d, r in after.items())
    from crx.llm.toxicity import train
    model = train(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert set(after) == {d for d, r in before.items() if model.score(r.text or "") < 0.5}


def test_exact_stage(stages):
    least = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in stages[1][2]:
        key = (r.text or "").translate(lower)
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2][2]) == sorted(least.values())


def test_near_stage(stages):
    before, after = stages[2][2], stages[3][2]
    sets = [shingle_set(r.text) for r in before]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both >= 0.8 * (len(a) + len(sets[j]) - both) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(before):
        least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_mixing_stage(stages):
    before, after = {r.doc_id: r for r in stages[3][2]}, stages[4][2]
    size, taken = Counter(), Counter()
    for r in before.values():
        size[r.source] += len(words(r.text))
    cut = 0
    for r in after:
        whole = before[r.doc_id]
        assert (r.source, r.lang) == (whole.source, whole.lang)
        assert r.text == whole.text or words(whole.text)[:len(words(r.text))] == words(r.text)
        cut += r.text != whole.text
        taken[r.source] += len(words(r.text))
    assert cut <= len(size)
    target = dict.fromkeys(size, 0.0)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    rest, free = 1.5 * sum(size.values()), set(size)
    while rest > 1e-6 and free:
        unit, over = rest / sum(weight[s] for s in free), 0.0
        for s in list(free):
            target[s] += unit * weight[s]
            if target[s] > 2 * size[s]:
                over += target[s] - 2 * size[s]
                target[s] = 2 * size[s]
                free.discard(s)
        rest = over
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert max(Counter(r.doc_id for r in after).values()) <= 2


def test_packing_stage(stages):
    by_seq = defaultdict(list)
    total = 0
    for r in stages[5][2]:
        by_seq[r.sequence_id].append((r.offset, r.length))
        total += r.length
        assert len(r.ids) == 4 * r.length
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by_seq) * 1024 - total <= 1024
    assert sum(r.doc_tokens for r in stages[5][2] if r.start == 0) == total


def test_run_gives_the_last_stage(stages, spark):
    rows = P.run(spark, SMALL).select("doc_id", "start", "length", "sequence_id", "offset").collect()
    assert sorted((r.doc_id, r.start, r.length) for r in rows) == sorted((r.doc_id, r.start, r.length) for r in stages[5][2])
