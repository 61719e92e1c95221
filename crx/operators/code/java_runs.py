"""Tokens of Java files and their features, many files at a time, in numpy over Arrow batches.

A file's tokens stand together and in order: neighbours are rows beside a row, running
counts are differences of prefix sums, and a bracket's partner is the next one in a stable
sort by (file, kind, level). No token is shuffled or sorted by Spark for that. Features are
given as functions of the rows they are wanted for, so that those of rows nobody keeps are
not put together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_TOKENS = 50_000  # files are taken together up to about so many tokens
BATCH_CHARS = 250_000  # or bytes, where they are not tokens yet

# The patterns of `java.py` for Python's `re`: `.` there stops at any line end, and a token
# ends where its line does, so that a file needs no cut into lines; a line end is a token here.
_ANY = "[^\n\r\x85\u2028\u2029]"
_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*+|[(){};.,\n]|\d[A-Za-z0-9_.]*+" rf'|"(?:\\{_ANY}|[^"\\\n])*+"' rf"|'(?:\\{_ANY}|[^'\\\n])*+'" rf"|//{_ANY}*+"
                    r"|&&|\|\||==|!=|<=|>=|\+\+|--|->|::|\+=|-=|[^\s\w]", re.ASCII)
_HIDING = re.compile(r'"""[\s\S]*?"""' rf'|"(?:\\{_ANY}|[^"\\\n])*+"' rf"|'(?:\\{_ANY}|[^'\\\n])*+'" r"|//[^\n]*+|/\*[\s\S]*?\*/", re.ASCII)
_KINDS = ["string", "number", "literal", "keyword", "ident", "op"]


def _shown(match: re.Match) -> str:
    hit = match[0]
    if hit.startswith(("/*", "//")):
        return "\n" * hit.count("\n")
    return '"' + re.sub(r'["\\\n]', " ", hit[3:]) + '"' + "\n" * hit.count("\n") if hit.startswith('"""') else hit


def _kind(word: str, keywords: frozenset[str]) -> int:
    first = word[0]
    if first in "\"'":
        return 0
    if "0" <= first <= "9":
        return 1
    if word in ("true", "false", "null"):
        return 2
    return 3 if word in keywords else 4 if first.isascii() and (first.isalpha() or first in "_$") else 5


def _encoded(column: pa.Array) -> pa.DictionaryArray:
    return column if pa.types.is_dictionary(column.type) else column.dictionary_encode("encode")


def _numbered(column: pa.Array) -> tuple[np.ndarray, dict]:
    """A number per value (nulls have one too), and the number of each value."""
    words = column.dictionary_encode("encode")
    return words.indices.to_numpy(), {w: i for i, w in enumerate(words.dictionary.to_pylist())}


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that part no file."""
    held, rows, before = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        files = b.column("file_id")
        number, _ = _numbered(files)
        starts = np.flatnonzero(number[1:] != number[:-1]) + 1
        cut = int(starts[-1]) if len(starts) else 0
        rows += b.num_rows
        if rows >= BATCH_TOKENS and held + [b] and (cut or (held and files[0] != before)):
            if ready := held + ([b.slice(0, cut)] if cut else []):
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            held, rows = [b.slice(cut)], b.num_rows - cut
        else:
            held.append(b)
        before = files[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Tokens:
    """The tokens of whole files: places of neighbours (-1: none), and tests of the tokens at places."""

    def __init__(self, tok: pa.DictionaryArray, kind: pa.DictionaryArray, idx: np.ndarray, line: np.ndarray, sizes: np.ndarray):
        self.n, self.idx, self.line = len(idx), pa.array(idx), pa.array(line)
        self.at = np.arange(self.n)
        opens = np.cumsum(sizes) - sizes
        self.file = np.repeat(np.arange(len(opens)), sizes)
        self.first, self.end = np.repeat(opens, sizes), np.repeat(opens + sizes, sizes)
        self._words = {"tok": tok, "kind": kind}
        self._codes = {name: (c.indices.to_numpy(), {w: i for i, w in enumerate(c.dictionary.to_pylist())}) for name, c in self._words.items()}

    @classmethod
    def of_rows(cls, batch: pa.RecordBatch) -> Tokens:
        """Of rows of tokens."""
        files, _ = _numbered(batch.column("file_id"))
        sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, files[1:] != files[:-1]]), batch.num_rows])
        tok, kind, idx, line = (batch.column(c) for c in ("tok", "kind", "idx", "line"))
        return cls(_encoded(tok), _encoded(kind), idx.to_numpy(), line.to_numpy(), sizes)

    @classmethod
    def of_texts(cls, texts: list[str], keywords: frozenset[str]) -> Tokens:
        """The tokens that `java_tokens` gives for the texts of files."""
        flat: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if "/*" in text or '"""' in text:
                text = _HIDING.sub(_shown, text)
            found = _TOKEN.findall(text)
            sizes[i] = len(found)
            flat += found
        tok = pa.array(flat, pa.string()).dictionary_encode("encode")
        codes, words = tok.indices.to_numpy(), tok.dictionary.to_pylist()
        break_, hidden = np.array([w == "\n" for w in words], dtype=bool)[codes], np.array([w.startswith("//") for w in words], dtype=bool)[codes]
        at, opens = np.arange(len(codes)), np.cumsum(sizes) - sizes
        file = np.repeat(np.arange(len(sizes)), sizes)
        breaks = np.r_[0, np.cumsum(break_)]
        line = breaks[:-1] - breaks[opens[file]] + 1
        # a token's place in its line, comments counted
        place = at - np.maximum(np.maximum.accumulate(np.where(break_, at + 1, 0)), opens[file])
        kept = np.flatnonzero(~(break_ | hidden))
        kinds = np.array([_kind(w, keywords) for w in words], dtype=np.int32)
        return cls(pa.DictionaryArray.from_arrays(tok.indices.take(pa.array(kept)), tok.dictionary), pa.DictionaryArray.from_arrays(kinds[codes[kept]], pa.array(_KINDS)),
                   (line[kept].astype(np.int64) << 32) + place[kept], line[kept].astype(np.int32), np.bincount(file[kept], minlength=len(texts)))

    def words(self, places: np.ndarray, column: str = "tok") -> pa.Array:
        """The tokens at places, or their kinds; null where there is none."""
        return self._words[column].dictionary.take(pa.array(self._codes[column][0][places], mask=places < 0))

    def near(self, steps: int) -> np.ndarray:
        p = self.at + steps
        return np.where((p >= self.first) & (p < self.end), p, -1)

    def has(self, places: np.ndarray, *values: str, column: str = "tok") -> np.ndarray:
        """Whether the token there is one of the values; False where there is none."""
        codes, number = self._codes[column]
        hit = np.zeros(len(number), bool)
        hit[[number[v] for v in values if v in number]] = True
        return hit[codes] if places is self.at else hit[codes[places]] & (places >= 0)

    def running(self, x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x, dtype=np.int64)
        return total - (total - x)[self.first]

    def last(self, when: np.ndarray, before: bool = False) -> np.ndarray:
        """The last place in the file where `when` holds, up to a token or before it."""
        p = np.maximum.accumulate(np.where(when, self.at, -1))
        p = np.r_[-1, p[:-1]] if before else p
        return np.where(p >= self.first, p, -1)

    def lists(self, members: np.ndarray, owners: np.ndarray) -> pa.Array:
        """Per token the tokens that it owns, in the members' order; null for none."""
        counts = np.bincount(owners, minlength=self.n)
        ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        return pa.ListArray.from_arrays(ends, self.words(members[np.argsort(owners, kind="stable")]), mask=pa.array(counts == 0))

    def beside(self, brackets: np.ndarray, brace: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next and the previous bracket of the same kind and level in the file."""
        keys = [k[brackets] for k in (level, brace, self.file)]
        order = np.lexsort(keys)
        same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
        a, b = brackets[order][:-1][same], brackets[order][1:][same]
        after, before = np.full(self.n, -1), np.full(self.n, -1)
        after[a], before[b] = b, a
        return after, before


def _owned(t: Tokens, last: dict[str, np.ndarray], declares: np.ndarray, pair: np.ndarray, pd: np.ndarray, ad: np.ndarray) -> dict[str, pa.Array]:
    """What statements hold, on the row of the token that opens them: an import's text, a
    class's bases, and a declared method's parameter names and annotations."""
    here, prev, nxt, ident = t.at, t.near(-1), t.near(1), t.has(t.at, "ident", column="kind")

    def members(of: np.ndarray, when: np.ndarray) -> pa.Array:
        found = np.flatnonzero(when)
        return t.lists(found, of[found])
    imported = (last["import_last"] >= 0) & (here > last["import_last"]) & (last["semi_last"] < last["import_last"]) & ~t.has(here, "static")
    of = last["class_last"]
    base = (of >= 0) & (here > of) & (last["lbrace_last"] < of) & ident & t.has(prev, "extends", "implements", ",") & (ad == ad[of])
    # a parameter's name stands before ',' or ')', directly in the declared list opened last
    names = np.flatnonzero(declares)
    opens = np.zeros(t.n, bool)
    opens[nxt[names]] = True
    step = opens.astype(np.int64)
    step[pair[nxt[names]]] -= 1
    of_list = t.last(opens)
    named = ident & t.has(nxt, ",", ")") & (t.running(step) > 0) & (of_list >= 0) & (pd == pd[of_list]) & (ad == ad[of_list])
    # a name's annotations stand after the latest statement end before it
    marks = np.flatnonzero(ident & t.has(prev, "@"))
    names = names[last["stmt_end_before"][names] >= 0]
    start = np.searchsorted(marks, last["stmt_end_before"][names], "right")
    count = np.searchsorted(marks, names) - start
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return {"import_text": pc.binary_join(members(last["import_last"], imported), ""), "bases": members(of, base),
            "args": members(of_list - 1, named), "annotated": t.lists(marks[np.repeat(start, count) + nth], np.repeat(names, count))}


def features(t: Tokens, primitives: list[str]) -> tuple[dict[str, Callable[[np.ndarray], pa.Array]], np.ndarray]:
    """The columns that `token_features` adds, each a function of the rows it is wanted for,
    and where a method is declared."""
    here, prev, prev2, nxt, nxt2, nxt3 = t.at, *(t.near(k) for k in (-1, -2, 1, 2, 3))
    opening, closing, lbrace, rbrace = (t.has(here, c) for c in "(){}")
    pd, bd = t.running(opening.astype(int) - closing), t.running(lbrace.astype(int) - rbrace)
    plevel, blevel = pd + closing, bd + rbrace
    paren, brace = opening | closing, lbrace | rbrace
    after, before = t.beside(np.flatnonzero(paren | brace), brace, np.where(paren, plevel, blevel))
    pair = np.where(opening & t.has(after, ")"), after, -1)
    block = np.where(lbrace & t.has(after, "}"), after, -1)
    past = np.where(pair >= 0, nxt[pair], -1)
    do_close = rbrace & t.has(before, "{") & t.has(np.where(before >= 0, prev[before], -1), "do")

    literal = t.has(here, "string", "number", "literal", column="kind")
    case_group = (t.has(here, "case") | t.has(here, "default") & t.has(nxt, ":")) & ~t.has(prev, ":")
    ternary = t.has(here, "?") & ~t.has(prev, "<", ",") & ~t.has(nxt, ">", "extends", "super", ",")
    decides = t.has(here, "if", "for", "while", "do", "catch", "&&", "||") | case_group | ternary
    counts = {"C": np.where(decides, 1, np.where(do_close & t.has(nxt, "while"), -1, 0)), "plus_pc": t.has(here, "+"),
              "nonlit_pc": ~literal & ~t.has(here, ",", "-", "+"), "binop_pc": t.has(here, "-", "+") & ~t.has(prev, "(", ","),
              "ad": t.has(here, "<").astype(int) - t.has(here, ">")}
    is_class = t.has(here, "class") & t.has(nxt, "ident", column="kind") & ~t.has(prev, ".")
    places = {"class_last": t.last(is_class), "lbrace_last": t.last(lbrace), "import_last": t.last(t.has(here, "import")),
              "semi_last": t.last(t.has(here, ";")), "rparen_before": t.last(closing, before=True),
              "stmt_end_before": t.last(t.has(here, ";", "{", "}"), before=True)}
    # of an identifier before '(': that bracket, its partner, and the first statement end after it if that is a '{'
    total = {name: t.running(x.astype(np.int64)) for name, x in counts.items()}
    called = np.where(t.has(here, "ident", column="kind") & t.has(nxt, "("), nxt, -1)
    close = np.where(called >= 0, pair[called], -1)
    stops = np.minimum.accumulate(np.where(t.has(here, ";", "{", "}"), t.at, t.n)[::-1])[::-1]
    stop = np.where((close >= 0) & (stops[close] < t.end[close]), stops[close], -1)
    body = np.where(t.has(stop, "{") & (t.last(closing, before=True)[stop] == close), stop, -1)
    body_end = np.where(body >= 0, block[body], -1)

    after_list = np.where(close >= 0, past[called], -1)
    typeish = t.has(prev, "ident", column="kind") | t.has(prev, *primitives, "void", ">", "]")
    opened = t.has(after_list, "{", "throws") & (typeish | t.has(prev, "public", "private", "protected", "{", "}", ";"))
    declares = (opened | t.has(after_list, ";") & typeish) & (prev >= 0) & ~t.has(prev, "new", ".", "::", "return", "else")

    def word(places: np.ndarray, column: str = "tok") -> Callable[[np.ndarray], pa.Array]:
        return lambda at: t.words(places[at], column)

    def number(values: np.ndarray, places: np.ndarray | None = None) -> Callable[[np.ndarray], pa.Array]:
        """A number of the row itself, or of the token at the row's place."""
        if places is None:
            return lambda at: pa.array(values[at])
        return lambda at: pa.array(values[places[at]], mask=places[at] < 0)

    def between(name: str, a: np.ndarray, b: np.ndarray, less: int = 0) -> Callable[[np.ndarray], pa.Array]:
        return lambda at: pa.array(total[name][b[at]] - total[name][a[at]] - less, mask=b[at] < 0)
    idx, line = t.idx.to_numpy(), t.line.to_numpy()
    own = np.where(paren, here, -1), np.where(brace, here, -1)
    return {
        "prev": word(prev), "prev_kind": word(prev, "kind"), "prev2": word(prev2), "next": word(nxt), "next_kind": word(nxt, "kind"), "next2": word(nxt2),
        "next2_kind": word(nxt2, "kind"), "next3": word(nxt3), "prev_line": number(line, prev), "next_idx": number(idx, nxt), "pd": number(pd), "bd": number(bd),
        "plevel": number(plevel, own[0]), "blevel": number(blevel, own[1]), "pmatch": number(idx, pair), "after_close": word(past), "after_close_idx": number(idx, past),
        "bmatch": number(idx, block), **{name: number(x) for name, x in total.items()}, **{name: number(idx, p) for name, p in places.items()},
        "call_close": number(idx, close), "call_after": word(after_list), "list_level": number(plevel, called), "list_ad": number(total["ad"], called),
        "plus_at": number(total["plus_pc"], called), "args_plus": between("plus_pc", called, close), "args_nonlit": between("nonlit_pc", called, close, 1),
        "args_binop": between("binop_pc", called, close), "body_open": number(idx, body), "body_close": number(idx, body_end), "body_decides": between("C", body, body_end),
        "body_last": number(line, np.where(body_end >= 0, prev[body_end], -1)),
        **{name: (lambda at, x=x: x.take(pa.array(at))) for name, x in _owned(t, places, declares, pair, pd, total["ad"]).items()}}, declares


def marked(t: Tokens, declares: np.ndarray, resources: list[str], counted: Iterable[str]) -> dict[str, np.ndarray]:
    """The tokens that `rule_marks` keeps, and those of them of which it keeps more columns."""
    here, prev, nxt, nxt2 = t.at, t.near(-1), t.near(1), t.near(2)
    literal, ident = ("string", "number", "literal"), t.has(here, "ident", column="kind")
    of = {"assigned": ident & t.has(nxt, "=") & t.has(nxt2, *literal, column="kind") & t.has(t.near(3), ";", ","),
          "plus": t.has(here, "+") & t.has(prev, *literal, column="kind") & t.has(nxt, *literal, column="kind"),
          "called": ident & t.has(nxt, "(") & ~t.has(prev, "new"), "declared": declares, "counted": t.has(here, *counted), "class": t.has(here, "class")}
    opened = t.has(here, "(") & t.has(prev, "try") | t.has(here, "{") & t.has(prev, "try", ")")
    kept = opened | t.has(here, "import", "throw") | t.has(here, "new") & t.has(nxt, *resources) | of["class"] & t.has(nxt, "ident", column="kind")
    return {"kept": kept | of["called"] | of["assigned"] | of["plus"], **of}


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[str]]]:
    """(ids, paths, texts) of files that have one, taken together up to `BATCH_CHARS`."""
    held, chars = [], 0
    for b in batches:
        b = b.filter(pc.is_valid(b.column("content")))
        start = 0
        for i, size in enumerate(pc.binary_length(b.column("content").cast(pa.binary())).to_pylist()):
            chars += size
            if chars >= BATCH_CHARS or i == b.num_rows - 1:
                held.append(b.slice(start, i + 1 - start))
                start = i + 1
            if chars >= BATCH_CHARS:
                yield _files(held)
                held, chars = [], 0
    if held:
        yield _files(held)


def _files(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, list[str]]:
    files = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return files.column("file_id"), files.column("path"), [x.decode("utf-8", "replace") for x in files.column("content").cast(pa.binary()).to_pylist()]
