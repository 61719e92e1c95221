"""Lexicon matching against plain edit distance; quotations; held-out accuracy."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crx.llm.toxicity import (LexiconTrie, Matcher, choose_terms, drop_toxic, edits_allowed, features, fit_logistic, is_quoted,
                              score_documents, train)

TERMS = {"idiot$": 3.0, "moron$": 3.0, "worthless$": 4.0, "cur$": 2.0, "vequ": 5.0, "lowei": 5.0}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(word):
    found = []
    for term, weight in TERMS.items():
        if term.endswith("$"):
            d = distance(term[:-1], word)
            if d <= edits_allowed(term):
                found.append((d, -weight))
        elif word.startswith(term):
            found.append((0, -weight))
    return (min(found)[0], -min(found)[1]) if found else None


words = st.one_of(st.sampled_from(["idiot", "moron", "worthless", "vequant", "loweie", "cur"]), st.text("idotmrnwhlesvquc", max_size=11))


@settings(max_examples=300, deadline=None)
@given(words, st.lists(st.tuples(st.integers(0, 12), st.sampled_from("idotmrnwhlesvqu*1"), st.booleans()), max_size=3))
def test_trie_equals_plain_distance(word, edits):
    for at, c, insert in edits:
        at = min(at, len(word))
        word = word[:at] + c + word[at if insert else at + 1:]
    assert LexiconTrie(TERMS).match(word) == brute(word)


def test_hits_and_benign_words():
    m = Matcher(LexiconTrie(TERMS), frozenset({"moroni"}))
    assert m.hit("«idiot»,") == (0, 3.0) and m.hit("id1ot!") == (1, 3.0) and m.hit("you-idiot") == (0, 3.0)
    assert m.hit("moroni") is None and m.hit("moronn") == (1, 3.0) and m.hit("...") is None
    assert LexiconTrie({}).match("x") is None


def test_quotation_is_told_from_abuse():
    m = Matcher(LexiconTrie(TERMS), frozenset())
    quoted = 'the article said that “the word idiot is rude” and moved on'
    abuse = "you are an idiot and that is all there is to it"
    q, a = features(quoted, m), features(abuse, m)
    assert q[4] > 0 and q[0] == 0
    assert a[0] > 0 and a[2] > 0 and a[4] == 0
    assert is_quoted('he wrote : such an idiot again'.split(), 5)
    assert not is_quoted("idiot".split(), 0)
    assert features("", m) == [0.0] * 6


def test_term_choice():
    stats = {"vequ": (100.0, 5.0), "veque": (40.0, 5.0), "veq": (97.0, 4.0), "idiot$": (80.0, 6.0), "idio": (81.0, 6.0), "idi": (80.5, 5.9)}
    assert choose_terms(stats) == {"vequ": 5.0, "idiot$": 6.0}


def test_logistic_fit_is_finite_when_separable():
    w = fit_logistic(np.array([[0.0], [0.0], [0.0], [2.0]]), np.array([0, 0, 0, 1.0]))
    assert np.isfinite(w).all() and w[1] > 0
    assert np.isfinite(fit_logistic(np.zeros((5, 2)), np.ones(5))).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    clean = [f"w{i:03d}q" for i in range(300)]
    bad = ["grobbel", "snarfy"]
    docs, labels = [], []
    for i in range(1500):
        w = list(rng.choice(clean, 40))
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(3):
                w[rng.integers(40)] = bad[rng.integers(2)] if i % 3 else "zzork" + str(rng.choice(clean))
        docs.append((i, " ".join(w), f"lang{toxic}", toxic))
        labels.append((i, 1, toxic))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_rows(spark, corpus):
    docs, labels = corpus
    model = train(docs, labels)
    assert {"grobbel$", "snarfy$", "zzork"} <= {t if t.endswith("$") else t[:5] for t in model.terms}
    rows = score_documents(docs, model).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(out) > 200 and np.mean([r.predicted == r.toxic for r in out]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert 1250 <= kept.count() <= 1350


def test_misspelled_terms_count(spark, corpus):
    model = train(*corpus)
    plain = "w001q w002q w003q w004q " * 8
    assert model.score(plain + "grobbel snarfy grobbel") > 0.5
    assert model.score(plain + "grobbell grobel snarfyy grobbbel") > model.score(plain)


def test_odd_rows(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "grobbel " * 50_000)], "doc_id long, text string")
    model = train(odd, labels.limit(0))
    assert {r.predicted for r in score_documents(odd, model).collect()} == {0}
    model = train(docs, labels)
    got = score_documents(odd, model).collect()
    assert len(got) == 4 and [r.predicted for r in got if r.doc_id == 2] == [1]
    assert {r.score for r in got if r.doc_id != 2} == {model.score("")}
    assert score_documents(odd.limit(0), model).count() == 0
    repeated = labels.union(labels.limit(40)).union(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema))
    assert train(docs, repeated).terms == model.terms
