"""Token ids of whole texts, by a public tokenizer file, inside Spark tasks.

The file is one of the `tokenizers` library. Where it is byte-level BPE with ids
in the order of its merges, the ids follow from the vocabulary alone and come
from tiktoken's encoder over that vocabulary, which is several times faster;
any other file is run by `tokenizers` itself.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BATCH_CHARS = 4_000_000
# Fixed value: how byte-level BPE of this kind cuts a text into pre-tokens.
_BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies:
    itself where printable, else the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encode_function(path: str) -> Callable[[str], list[int]]:
    """text -> ids without special tokens, whose strings are ordinary text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and not spec.get("normalizer")):
        symbols = _byte_symbols()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in special}
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merged]
        if ids == sorted(ids) and len(ranks) == max(ranks.values()) + 1:
            import tiktoken
            return tiktoken.Encoding("file", pat_str=_BYTE_LEVEL_PATTERN, mergeable_ranks=ranks,
                                     special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text, add_special_tokens=False).ids


def as_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit values (little-endian machines)."""
    return array("I", ids).tobytes()


_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """The encode function of a file, made once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = encode_function(path)
    return _ENCODERS[path]


def in_chunks(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """[start, end) of runs of texts with about `limit` characters."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= limit:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tokenised(path: str, end_id: int, window: int):
    """For mapInArrow over (doc_id, text, part): the ids with `end_id` after them,
    and running counts within the partition: `tail_rank`, of earlier documents
    whose last, shorter piece has the same length, and `full_before`, of whole
    windows in earlier documents."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tails = np.zeros(window, dtype=np.int64)
        full, pos = 0, 0
        for batch in batches:
            ids_col, part_col = batch.column(0), batch.column(2)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts):
                ids = [as_bytes(enc(t)) + end for t in texts[a:b]]
                n_tokens = [len(x) // 4 for x in ids]
                ranks, befores = [], []
                for n in n_tokens:
                    ranks.append(int(tails[n % window]))
                    befores.append(full)
                    tails[n % window] += 1
                    full += n // window
                yield pa.RecordBatch.from_arrays(
                    [ids_col.slice(a, b - a), part_col.slice(a, b - a), pa.array(range(pos, pos + b - a), pa.int64()),
                     pa.array(n_tokens, pa.int64()), pa.array(ranks, pa.int64()), pa.array(befores, pa.int64()),
                     pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "pos", "n_tokens", "tail_rank", "full_before", "ids"])
                pos += b - a
    return run
