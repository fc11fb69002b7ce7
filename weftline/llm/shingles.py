"""Word shingles of whole texts as 64-bit hashes, vectorised over batches of texts.

Words are the longest runs of a-z and 0-9 in the lower-cased text. A word's hash is a polynomial
over its bytes, taken from prefix sums of the whole batch (the powers of the base are units modulo
2^64, so the same word has the same hash at any place), then mixed; a shingle's hash combines the
hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixing of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def _slices(encoded: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, x in enumerate(encoded):
        if size and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(encoded):
        yield start, len(encoded)


def shingle_sets(texts: list[str | None], width: int, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, hashes): for each text with at least ``min_words`` words its row number and
    its sorted distinct shingle hashes at hashes[offsets[i]:offsets[i + 1]]."""
    encoded = [x.lower().encode("utf-8", "surrogatepass") if x else b"" for x in texts]
    for lo, hi in _slices(encoded):
        part = encoded[lo:hi]
        raw = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        row_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])[:-1]])
        inside = _LETTER[raw]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            continue
        up, down = _powers(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[raw] * up[: len(raw)], dtype=np.uint64)])
        word = mix((sums[e] - sums[s]) * down[s])
        row = np.searchsorted(row_at, s, "right") - 1
        n_words = np.bincount(row, minlength=len(part))
        if len(word) < width:
            continue
        h = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            h = mix(h * _U(0xD1342543DE82EF95) + word[k : k + len(h)])
        r = row[: len(h)]
        ok = (r == row[width - 1 :]) & (n_words[r] >= max(min_words, width))
        h, r = h[ok], r[ok]
        if not len(h):
            continue
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        h, r = h[fresh], r[fresh]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        yield r[at] + lo, np.concatenate([at, [len(h)]]), h
