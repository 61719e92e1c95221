"""Exact dedup, mixing and URL rules: SQL on the smallest tables, odd rows, plans."""

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import oracle_check  # noqa: E402

from crx.llm import queries  # noqa: E402
from crx.llm.exact_dedup import drop_exact_copies, exact_groups  # noqa: E402
from crx.llm.mixing import mix_documents, mixture, source_targets  # noqa: E402
from crx.llm.url_rules import judge_urls  # noqa: E402

SMALL = "/root/testdata/sf0.001"
queries.load_all()


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_equals_sql(spark, duck_small, key):
    oracle_check.SF = SMALL
    r = oracle_check.compare(spark, duck_small, key, queries.QUERIES[key], queries.ORACLES[key])
    assert r["cols_match"] and r["values_match"] and r["rows"] == r["oracle_rows"], r


@pytest.mark.parametrize("key", ["op3_pii", "op4_exact_dedup", "op5_secrets", "op7_mixing", "op9_url_rules"])
def test_no_python_and_no_cross_join_in_the_plan(spark, key):
    plan = queries.QUERIES[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_exact_groups_on_odd_rows(spark):
    long = "Äb " * 50_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "Ab", "x"), (4, "aB", "x"), (5, "ÄB", "x"), (6, "äb", "x"), (7, long, "x"), (8, long.replace("b", "B"), "x"),
            (8, long.replace("b", "B"), "x"), (None, "ab", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash128 string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(df, keep="max").collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False), (5, 5, 1, True), (6, 6, 1, True),
                   (7, 8, 3, False), (8, 8, 3, True)}
    assert exact_groups(df, keep="max").count() == len(rows)
    left = drop_exact_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6, 7]
    assert exact_groups(df.limit(0)).count() == 0 and drop_exact_copies(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert drop_exact_copies(nulls).count() == 1 and not any(r.kept for r in exact_groups(nulls).collect())
    with pytest.raises(ValueError):
        exact_groups(df, keep="first")


def fill(sizes, share=1.5, epochs=2.0, weights=(3, 1, 2)):
    """Targets by repeated sharing: sizes in order of source."""
    target, rest, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while rest > 1e-9 and free:
        unit, over = rest / sum(weights[i % 3] for i in free), 0.0
        for i in list(free):
            target[i] += unit * weights[i % 3]
            if target[i] >= epochs * sizes[i]:
                over += target[i] - epochs * sizes[i]
                target[i] = epochs * sizes[i]
                free.discard(i)
        rest = over
    return target


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 5], [0, 7, 0, 900, 3], [5], [0, 0], [100, 1, 1, 1, 1, 1, 1]])
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = [(f"s{i}", f"k{i:03d}", n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "skey string, source string, source_size long")
    got = {r.skey: r.target for r in source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(fill(sizes))


def test_mixture_on_odd_rows(spark):
    rows = [(i, f"w{i} " * (i % 7), "hot" if i % 3 else "b", 5, "k") for i in range(400)]
    rows += [(900, None, None, 0, "k"), (901, "\t \n", None, 3, "k"), (902, "a b c", None, 5, "k"), (902, "a b c", None, 5, "k"), (None, "x", "hot", 1, "k"),
             (903, "one " * 30_000, "long", 1, "k"), (904, "ü\u00a0ü ü", "n", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")
    got = mixture(df, rows_per_range=50).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = dict(zip(order, fill([sizes[s] for s in order]), strict=True))
    for s in order:
        mine = [r for r in got if r.source == s]
        assert mine[0].target == pytest.approx(target[s])
        assert sum(r.taken for r in mine) == round(target[s] + 1e-9) or abs(sum(r.taken for r in mine) - target[s]) <= 0.5
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixture(df, rows_per_range=7).collect())
    mixed = mix_documents(df, rows_per_range=50)
    assert mixed.columns == df.columns
    out = mixed.collect()
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    for s in order:
        assert sum(words(r.text) for r in out if r.source == s) == sum(r.taken for r in got if r.source == s)
    assert mixture(df.limit(0)).count() == 0 and mix_documents(df.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.example.org", "", "allow"), ("", "/ad", "block"), ("example.org", "/es/x", "allow"), ("Example.ORG", "/es/x", "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, tail = rest[:cut].translate(lower), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    rules = {}
    for h, p, a in RULES:
        rules[(h.translate(lower), p)] = max(a, rules.get((h.translate(lower), p), ""))
    fits = [(len(h + p), len(h), h + p, a) for (h, p), a in rules.items() if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules_on_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://org", "http://ORG/", "https://www.Example.org/es/", "https://example.org/es", "http://a.b.example.org/es/x/y?z",
            "http://example.org/en/12", "http://example.org/en/2", "ftp://x.com/fr/a", "http://com/de/", "http://xcom/de/", "http://a.example.org", "http://x.y/ad/1#f",
            "http://example.org/es/\U0010ffff", "http://" + "a." * 3000 + "example.org/es/q", "http://h/" + "p" * 20_000, "a://b://org/", "http://example.org?x/es/", "http://.org/", "http://Ü.org/É",
            # separators of any kind inside a host are part of its labels
            "http://org,example/es/x", "http://example,org/es/", "http://com,/fr/", "http://org\x00example/es/", "http://org\x00/es/", "http://a,b.example.org/es/",
            "http://\x00.org/", "http://org\x01example/es/", "http://example.org\x00/es/", "http://example.org/\x00es/", "http://org:80/", "http://.example.org/es/", "http://org./"]
    urls += [f"http://s{i % 9}.example.{'org' if i % 2 else 'com'}/{'es' if i % 3 else 'de'}/{i % 40}" for i in range(400)]
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(3, "://", "x", "y"), (None, "http://org/", "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    impossible = [("org/example", "", "block"), ("org?", "/", "block"), ("example#", "/", "block"), ("org,example", "/zz", "block")]
    rules = spark.createDataFrame(RULES + impossible, "host string, path string, action string")
    got = sorted(((r.page_id if r.page_id is not None else -1, (r.host, r.path, r.rule, r.verdict)) for r in judge_urls(pages, rules).collect()), key=str)
    assert got == sorted(((i if i is not None else -1, judge(u)) for i, u, _, _ in rows), key=str)
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
