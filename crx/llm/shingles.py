"""Word shingles and MinHash values of many texts at once, in numpy.

Words are runs of bytes other than space and U+0009-U+000D. A text of fewer than
`k` words has one shingle, of all its words; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", _BASE_INV)):
            seq = np.full(size, b, dtype=_U)
            seq[0] = 1
            _POWERS[name] = np.multiply.accumulate(seq)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """[start, end) of runs of texts with about CHUNK_BYTES bytes."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= CHUNK_BYTES:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_hashes(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, text after text; number of shingles per text)."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    text_ends = np.cumsum(sizes + 1) - 1  # the separator after each text
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.diff(np.searchsorted(starts, text_ends, side="left"), prepend=0)
    up, down = _powers(len(buf) + 1)
    sums = np.empty(len(buf) + 1, dtype=_U)
    sums[0] = 0
    np.cumsum((buf.astype(_U) + _U(1)) * up[:len(buf)], out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    n_shingles = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    total = int(n_shingles.sum())
    if not total:
        return np.empty(0, dtype=_U), n_shingles
    first_word = np.cumsum(words) - words
    # first word of each shingle
    text_of = np.repeat(np.arange(len(texts)), n_shingles)
    within = np.arange(total) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    at = first_word[text_of] + within
    n_words = np.minimum(words, k)[text_of]
    out = n_words.astype(_U)
    padded = np.concatenate([word, np.zeros(k, dtype=_U)])
    factor = _BASE
    for j in range(k):
        part = padded[at + j] * _U(factor)
        if (n_words <= j).any():
            part = np.where(n_words > j, part, _U(0))
        out = out + part
        factor = (factor * _BASE) % (1 << 64)
    return mix(out), n_shingles


class MinHash:
    """`n` universal hash functions a*x + b modulo 2**64, minimum of each over a
    text's shingles (upper 32 bits). A text without shingles gets the largest
    value everywhere."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, n, dtype=_U) * _U(2) + _U(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=_U)

    def signatures(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full((len(counts), len(self.a)), 0xFFFFFFFF, dtype=np.uint32)
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            for j, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                out[some, j] = np.minimum.reduceat(hashes * a + b, starts) >> _U(32)
        return out
