"""Packing against a plain tokenisation, and the tail plan on odd histograms."""

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crx.llm.packing import combinations, pack_documents, plan_tails, solve_counts
from crx.llm.q_text import op6_packing, tokenizer_path
from crx.llm.tokens import encode_function

SMALL = "/root/testdata/sf0.001"


def reference_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def check_sequences(rows, window):
    """rows: (sequence_id, offset, length); returns the padding."""
    by_seq = defaultdict(list)
    for s, o, n in rows:
        by_seq[s].append((o, n))
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= window
        padding += window - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padding


def test_query_round_trip(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = dict(zip(docs, [x + [0] for x in reference_ids(list(docs.values()))], strict=True))
    rows = op6_packing(spark, SMALL).collect()
    padding = check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 1024)
    assert padding <= 1024
    by_doc = defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(array("I", part).tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[d])


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "x  y\n z " * 300, "b"), (2, "<|endoftext|> it's\n\n", None), (3, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pack_documents(df, tokenizer_path(), window=64).collect()
    check_sequences([(r.sequence_id, r.offset, r.length) for r in out], 64)
    want = sum(len(x) + 1 for x in reference_ids([r[1] or "" for r in rows]))
    assert sum(r.length for r in out) == want
    assert sum(1 for r in out if r.doc_id == 1) == 2
    assert pack_documents(df.limit(0), tokenizer_path()).count() == 0


def test_ids_equal_the_library(spark):
    texts = ["a  b", " x", "x ", "\n\nfoo \n bar", "it's <|endoftext|> ok", "é² ñ z", "a\tb\r\n", "日本語 🙂🙃", "don't  'LL"]
    enc = encode_function(tokenizer_path())
    assert [enc(t) for t in texts] == reference_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 500), max_size=12))
def test_tail_plan_places_every_tail_once(counts):
    h = np.zeros(64, dtype=np.int64)
    for k, v in counts.items():
        h[k] = v
    lots, made = plan_tails(h, 64)
    pieces, rows = defaultdict(list), []
    for lot in lots:
        for i in range(lot.count):
            pieces[lot.tail, lot.rank0 + i].append((lot.cut0, lot.cut1))
            rows.append((lot.sequence0 + i, lot.offset, lot.cut1 - lot.cut0))
    assert set(pieces) == {(k, i) for k, v in counts.items() for i in range(v)}
    for (tail, _), parts in pieces.items():
        at = 0
        for a, b in sorted(parts):
            assert a == at
            at = b
        assert at == tail
    assert check_sequences(rows, 64) < 64 * 2
    assert made == len({r[0] for r in rows})


def test_solver_fits_a_fillable_histogram():
    lengths = np.array([10, 20, 30, 44, 54])
    combos = combinations(lengths, 64)
    assert {tuple(sorted(int(v) for v in row if v)) for row in combos} == {(20, 44), (10, 54), (10, 10, 44)}
    want = np.zeros(64)
    for row, n in zip(combos, [500, 300, 200], strict=True):
        for v in row:
            if v:
                want[v] += n
    x = solve_counts(combos, want)
    fit = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=64)
    assert fit[1:] == pytest.approx(want[1:], rel=0.02, abs=2)
