"""WARC derivatives against the standard HTML parser and recomputed digests."""

import base64
import gzip
import hashlib
import re
import time
import zlib
from html import unescape
from html.parser import HTMLParser

from crx.llm.q_text import op2_warc
from crx.llm.warc import as_warc, build_derivatives, decoded_body, page_facts, plain_text, read_page, responses_of_pages, split_message

SMALL = "/root/testdata/sf0.001"


class Words(HTMLParser):
    """All visible words, with spaces only where markup breaks a word."""
    HIDDEN = {"script", "style", "template", "noscript", "svg", "head"}
    INLINE = {"b", "a", "i", "em", "span", "strong"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        if tag not in self.INLINE:
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.hidden.remove(tag)
        if tag not in self.INLINE:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query_links_and_digests(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    responses = {r.record_id: r for r in responses_of_pages(pages).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    rows = op2_warc(spark, SMALL).collect()
    assert len(rows) == 2 * len(responses) == 2 * len(html)
    assert len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source = responses[r.refers_to]
        assert r.target_uri == source.target_uri and r.warc_date == source.warc_date
        assert r.block_digest == sha(r.block.encode()) and r.content_length == len(r.block.encode())
        assert "Content-Type: text/html" in r.source_headers and r.source_status == "HTTP/1.1 200 OK"
        body = html[source.page_id].encode()
        if r.warc_type == "metadata":
            assert r.payload_digest == sha(body) and f"source-payload-digest: {sha(body)}\r\n" in r.block
            title = unescape(re.search("<title>(.*?)</title>", html[source.page_id]).group(1))
            assert f"title: {' '.join(title.split())}\r\n" in r.block
            assert r.block.count("outlink: ") == html[source.page_id].count("<a href=")
        else:
            assert r.payload_digest == sha(r.block.encode())
            parser = Words()
            parser.feed(html[source.page_id])
            assert r.block.split() == "".join(parser.out).split()


def test_plain_text():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- a <p> b --><h1>A &amp; B</h1><p>one <b>tw</b>o"
            "<br>three<script>var t='</p>';</script></p><table><tr><td>x</td><td>y</td></tr></table>&lt;tag&gt; 1 < 2</body></html>")
    assert plain_text(page) == "A & B\none two\nthree\nx y\n<tag> 1 < 2"
    assert plain_text("") == "" and plain_text("<script>never closed") == "" and plain_text("<!-- never closed") == ""
    assert plain_text("<p>" * 20_000 + "x") == "x"


def test_odd_rows(spark):
    message = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/plain; charset=latin-1\r\nX-A: 1\r\n\r\ncaf\xe9"
    rows = [("<urn:uuid:1>", "http://a", "2024-01-01T00:00:00Z", message, "k"), ("<urn:uuid:2>", None, None, None, "k"), (None, "http://b", None, b"plain \xff", "k"),
            (None, "http://b", None, b"plain \xff", "k"), ("<urn:uuid:3>", "http://c", None, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", "k"),
            ("<urn:uuid:4>", "http://d", None, b"<p>" + b"word " * 200_000, "k")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, warc_date string, message binary, block string")
    out = build_derivatives(df).collect()
    of = lambda rid: {r.warc_type: r for r in out if r.refers_to == rid}
    one = of("<urn:uuid:1>")
    assert one["conversion"].block == "café" and one["metadata"].payload_digest == sha(b"caf\xe9")
    assert "source-header-x-a: 1\r\n" in one["metadata"].block and one["conversion"].source_status == "HTTP/1.1 404 Not Found"
    assert of("<urn:uuid:2>")["conversion"].block == ""
    assert set(of("<urn:uuid:3>")) == {"metadata"}
    assert len(of("<urn:uuid:4>")["conversion"].block.split()) == 200_000
    twins = [r for r in out if r.target_uri == "http://b"]
    assert len(twins) == 4 and len({r.record_id for r in twins}) == 2
    assert build_derivatives(df.limit(0)).count() == 0
    assert responses_of_pages(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).count() == 1
    warc = as_warc(build_derivatives(df.limit(1))).collect()
    for w in warc:
        head, _, block = bytes(w.warc).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head).group(1))
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Refers-To: <urn:uuid:1>" in head and block[n:] == b"\r\n\r\n"


def test_split_message():
    assert split_message(b"no http") == ("", [], b"no http")
    assert split_message(b"HTTP/1.1 200 OK\r\nA: b: c\r\nbad\r\n\r\nx\r\n\r\ny") == ("HTTP/1.1 200 OK", [("A", "b: c")], b"x\r\n\r\ny")


def test_hostile_pages_take_linear_time():
    """Openings without ends: time grows with the page, not with its square."""
    for unit in ("<a x ", "<a href=\" ", "<a href=  ", "<html ", "<html lang ", "<head>", "</head", "<title>", "<!--", "<script>", "</script ", "<svg/>", "<", "&#1", "\n ", "<body <head "):
        for end in ("", ">"):
            begin = time.process_time()
            read_page((unit + end) * (2_000_000 // len(unit + end)))
            assert time.process_time() - begin < 12, unit
    assert read_page("<a " * 3_000_000)[0] == ""
    assert plain_text("&#" + "1" * 100_000 + "; &#0000065; &#x000000041;") == "\ufffd A A"


def test_tags_in_one_scan():
    assert plain_text("a<svg/>b<svg x=1 />c<svg>d</svg>e") == "abc e"
    assert plain_text("x<script/>y</script>z") == "x z" and plain_text("x<STYLE>y</style  >z") == "x z"
    assert plain_text("<head>a<title>b</title>c") == "a\nb\nc"  # a head without an end is text
    assert plain_text("<head>a<body>b<head>c</head>d") == "bcd"  # only the first one is left out
    assert plain_text("1 <2 <3> </ x> y</p") == "1 <2 <3> y"
    assert page_facts("<html x lang='de-AT'><head><title> a <b>&amp;</b>\nc</title></head><a name=1><a class=x href = y&amp;z ><A HREF='q r'>") == [
        ("title", "a & c"), ("language", "de-AT"), ("outlink", "y&z"), ("outlink", "q r")]
    assert page_facts("<!-- <a href=x> --><script><a href=y></script><title>open") == [("title", "open")]


def test_transfer_and_content_codings(spark):
    text = "<html><title>T</title><p>wörds here".encode()
    chunked = b"5\r\n" + text[:5] + b"\r\n" + f"{len(text) - 5:x};ext=1\r\n".encode() + text[5:] + b"\r\n0\r\nTrailer: x\r\n\r\n"
    te, gz = ("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")
    assert decoded_body([te], chunked) == text and decoded_body([gz], gzip.compress(text)) == text and decoded_body([], text) == text
    both = gzip.compress(text)
    assert decoded_body([te, gz], f"{len(both):x}\r\n".encode() + both + b"\r\n0\r\n\r\n") == text
    raw = zlib.compressobj(wbits=-15)
    assert decoded_body([("content-encoding", "deflate")], zlib.compress(text)) == decoded_body([("content-encoding", "deflate")], raw.compress(text) + raw.flush()) == text
    assert decoded_body([te], text) == text and decoded_body([gz], text) == text  # stored decoded
    assert decoded_body([te], b"ff\r\nshort") is None and decoded_body([gz], both[:4] + b"zzzz") is None and decoded_body([("Content-Encoding", "br")], b"x") is None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: gzip\r\n\r\n"
    df = spark.createDataFrame([("<urn:uuid:1>", "http://a", "d", head + both), ("<urn:uuid:2>", "http://b", "d", head + both[:4] + b"zzzz")],
                               "record_id string, target_uri string, warc_date string, message binary")
    out = {(r.refers_to, r.warc_type): r for r in build_derivatives(df).collect()}
    assert set(out) == {("<urn:uuid:1>", "metadata"), ("<urn:uuid:1>", "conversion"), ("<urn:uuid:2>", "metadata")}
    assert out["<urn:uuid:1>", "conversion"].block == "T\nwörds here"
    assert out["<urn:uuid:1>", "metadata"].payload_digest == sha(both)
    for w in as_warc(build_derivatives(df)).collect():
        assert b"\r\nWARC-Source-Status: HTTP/1.1 200 OK\r\nWARC-Source-Header: Content-Type: text/html\r\nWARC-Source-Header: Content-Encoding: gzip\r\n" in bytes(w.warc)
