"""WARC derivatives: from response records, linked metadata and text conversions.

A response is an HTTP message as it was received. For each, the builder makes a
`metadata` record (what the message says about itself, as application/warc-fields)
and, for HTML and plain text, a `conversion` record (the readable text). Both
carry WARC-Refers-To, target, date and source headers of the response, and both
have block digests of their own. A record depends on its response alone, so the
work is one pass in Spark tasks without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.plans.session import ship_package

RECORD_SCHEMA = ("warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
                 "source_status string, source_headers string, block_digest string, payload_digest string, content_length long, block string")
# Elements whose content is not text, those that end a line, and cells.
HIDDEN = {"script", "style", "template", "noscript", "svg"}
BREAKS = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "h1", "h2", "h3",
          "h4", "h5", "h6", "blockquote", "pre", "figure", "form", "title", "br", "hr"}
CELLS = {"td", "th"}
_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9]*+)[^>]*+>?|[a-zA-Z/!?][^>]*+>?)")
_CLOSE = {name: re.compile(rf"</{name}\s*+>", re.I) for name in {*HIDDEN, "title"}}
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\">]*+)\"|'([^'>]*+)'|([^\s>]++))", re.I)
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_TOO_LARGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,8})[^\r\n]*+\r?\n")


def digest(data: bytes) -> str:
    """sha1: and the Base32 digest, as in WARC headers."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    """The same urn:uuid for the same response and kind, so that reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"


def _unescaped(text: str) -> str:
    """Character references resolved; numbers that no character has become U+FFFD."""
    return html.unescape(_TOO_LARGE.sub("\ufffd", _ZEROS.sub(r"&#\1", text)))


def read_page(page: str) -> tuple[str, list[tuple[str, str]]]:
    """(readable text, facts) of an HTML page in one scan from tag to tag.

    The text has a line per block, single spaces and no markup; facts are title,
    language and links, in warc-fields form. A tag ends at the next `>`, or with the page.
    A comment or hidden element without its end hides the rest of the page, a head without
    one is text. Every search either moves the scan behind what it found or is the last of
    its kind, so the time grows with the page alone."""
    out: list[str] = []
    head: list[str] | None = None  # what the first head holds, as long as it is open
    head_seen = False
    title, language, links = None, None, []
    at = 0
    while (m := _TAG.search(page, at)) is not None:
        into = out if head is None else head
        into.append(page[at:m.start()])
        at = m.end()
        name, closing = (m[2] or "").lower(), bool(m[1])
        if m[0] == "<!--" or name in HIDDEN and not closing and not (name == "svg" and m[0].endswith("/>")):
            end = _CLOSE[name].search(page, at) if name else None
            behind = end.end() if end else page.find("-->", at) + 3 if not name else 2
            into.append(" ")
            at = behind if behind > 2 else len(page)
            continue
        if name == "head" and not closing and not head_seen:
            head, head_seen = [], True
        elif head is not None and (name == "head" and closing or name == "body" and not closing):
            head = None
            out.append("\n")
        into = out if head is None else head
        into.append("\n" if name in BREAKS else " " if name in CELLS else "")
        if closing:
            continue
        if name == "title" and title is None:
            end = _CLOSE["title"].search(page, at)
            title = _TAG.sub("", page[at:end.start() if end else len(page)])
        elif name == "html" and language is None and (found := _LANG.search(m[0])):
            language = found[1]
        elif name == "a" and (found := _HREF.search(m[0])):
            links.append(next(g for g in found.groups() if g is not None))
    (out if head is None else head).append(page[at:])
    out += head or []
    text = _LINES.sub("\n", _SPACE.sub(" ", _unescaped("".join(out)))).strip()
    facts = [("title", " ".join(_unescaped(title).split()))] if title is not None else []
    facts += [("language", language)] if language else []
    return text, facts + [("outlink", " ".join(_unescaped(x).split())) for x in links]


def plain_text(page: str) -> str:
    """Readable text of an HTML page."""
    return read_page(page)[0]


def page_facts(page: str) -> list[tuple[str, str]]:
    """Title, language and links of an HTML page."""
    return read_page(page)[1]


def split_message(message: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, body) of an HTTP message; one that does not begin
    with a status line is all body."""
    if not message.startswith(b"HTTP/"):
        return "", [], message
    head, _, body = message.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = [(n.strip(), v.strip()) for n, sep, v in (line.partition(":") for line in lines) if sep]
    return status, fields, body


def _unchunked(body: bytes) -> bytes | None:
    """The data of a chunked body; None if its chunks are not whole."""
    out, at = [], 0
    while (m := _CHUNK.match(body, at)) is not None:
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        if m.end() + size > len(body):
            return None
        out.append(body[m.end():m.end() + size])
        at = m.end() + size
        at += 2 if body[at:at + 2] == b"\r\n" else 1 if body[at:at + 1] == b"\n" else 0
    return None


def _inflated(body: bytes, bits: int) -> bytes | None:
    """The whole data; None if it breaks off."""
    stream = zlib.decompressobj(bits)
    data = stream.decompress(body)
    return data if stream.eof else None


def decoded_body(fields: list[tuple[str, str]], body: bytes) -> bytes | None:
    """The body without its transfer and content codings (chunked, gzip, deflate, the
    last applied first); None if one is unknown or its data is broken. A body that says
    chunked or gzip but does not begin so was stored decoded and is taken as it is."""
    codings = lambda name: [c.strip().lower() for n, v in fields if n.lower() == name for c in v.split(",") if c.strip()]
    if "chunked" in codings("transfer-encoding") and _CHUNK.match(body):
        body = _unchunked(body)
    for coding in reversed(codings("content-encoding")):
        if body is None:
            return None
        try:
            if coding in ("gzip", "x-gzip"):
                body = _inflated(body, 31) if body[:2] == b"\x1f\x8b" else body
            elif coding == "deflate":
                body = _inflated(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
            elif coding != "identity":
                return None
        except zlib.error:
            return None
    return body


def _charset(content_type: str) -> str:
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    try:
        "".encode(m.group(1) if m else "utf-8")
    except LookupError:
        return "utf-8"
    return m.group(1) if m else "utf-8"


def derivatives(record_id: str, target_uri: str, date: str, message: bytes) -> list[tuple]:
    """The records that follow from one response, in RECORD_SCHEMA's order."""
    status, fields, body = split_message(message)
    kind = next((v for n, v in fields if n.lower() == "content-type"), "")
    media = kind.split(";")[0].strip().lower()
    whole = decoded_body(fields, body)
    text = "" if whole is None else whole.decode(_charset(kind), "replace")
    is_html = media in ("text/html", "application/xhtml+xml") or (not media and text.lstrip()[:1] == "<")
    payload_digest, source_headers = digest(body), "\r\n".join(f"{n}: {v}" for n, v in fields)
    clean, said = read_page(text) if is_html else (text, [])
    facts = [("source-status", status), ("source-payload-digest", payload_digest), ("source-content-length", str(len(body))),
             *[(f"source-header-{n.lower()}", v) for n, v in fields], *said]
    made = [("metadata", "application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in facts), payload_digest)]
    if whole is not None and (is_html or media == "text/plain" or not media):
        made.append(("conversion", "text/plain; charset=utf-8", clean, digest(clean.encode("utf-8", "replace"))))
    out = []
    for name, content_type, block, payload in made:
        data = block.encode("utf-8", "replace")
        out.append((name, derived_id(record_id, name), record_id, target_uri, date, content_type, status, source_headers,
                    digest(data), payload, len(data), data.decode("utf-8")))
    return out


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of responses (record_id, target_uri, warc_date,
    message binary), RECORD_SCHEMA.

    Every response gives one metadata record; HTML, plain text and untyped bodies
    give one conversion record too, unless the body's coding (chunked, gzip, deflate) is
    unknown or broken. Digests of the payload are of the body as received. block_digest is of the record's own block; the
    payload digest of a metadata record is the response's, of a conversion record
    that of its text. A null message is an empty one, null fields are empty; a
    response without id gets one from its target and message. Repeated responses
    give repeated records with the same ids; an empty table gives an empty result;
    other columns are ignored."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    ship_package(responses.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for record_id, uri, date, message in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                uri, message = uri or "", message or b""
                rid = record_id or derived_id(uri + digest(message), "response")
                rows += derivatives(rid, uri, date or "", message)
                size += len(message)
                if size > 8_000_000:
                    yield _batch(rows, names)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, names)
    return responses.select("record_id", "target_uri", "warc_date", F.col("message").cast("binary").alias("message")).mapInArrow(run, RECORD_SCHEMA)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "content_length" else pa.string())
                                       for n, c in zip(names, columns, strict=True)], names=names)


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html") -> DataFrame:
    """Response records of stored pages: the HTML as the body of a 200 answer. The id
    follows from page id and url; null html is an empty body."""
    body = F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    hexed = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))))
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">")).alias("record_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.lit(date).alias("warc_date"), F.encode(F.concat(head, body), "utf-8").alias("message"))


def as_warc(records: DataFrame) -> DataFrame:
    """Records as WARC/1.1 bytes (record_id, warc binary), ready to be written in any
    grouping of files. The source's status line and header fields follow as extension
    fields, one WARC-Source-Header each. Line ends inside a value become spaces."""
    line = "\r\n"
    value = lambda c: F.regexp_replace(F.col(c).cast("string"), "[\r\n]+", " ")
    fields = [F.concat(F.lit(f"{n}: "), value(c)) for n, c in (
        ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"),
        ("Content-Type", "content_type"), ("Content-Length", "content_length"))]
    status = F.when(F.col("source_status") != "", F.concat(F.lit("WARC-Source-Status: "), value("source_status")))
    sources = F.when(F.col("source_headers") != "", F.concat(F.lit("WARC-Source-Header: "), F.regexp_replace(F.col("source_headers"), line, f"{line}WARC-Source-Header: ")))
    head = F.concat_ws(line, F.lit("WARC/1.1"), *fields, status, sources)
    return records.select("record_id", F.encode(F.concat(head, F.lit(line + line), F.col("block"), F.lit(line + line)), "utf-8").alias("warc"))
