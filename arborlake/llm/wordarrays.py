"""Words of many texts as numpy arrays: boundaries and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

import numpy as np

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_PART = 1 << 20


def inverse(p: int) -> int:
    """Of an odd number, modulo 2^64."""
    return pow(p, -1, 1 << 64)


_tables: dict[int, np.ndarray] = {}


def powers(p: int, n: int) -> np.ndarray:
    """p^0 .. p^(n-1) modulo 2^64."""
    if p not in _tables or len(_tables[p]) < n:
        out = np.full(1 << max(10, (n - 1).bit_length()), p, np.uint64)
        out[0] = 1
        _tables[p] = np.multiply.accumulate(out)  # the largest one has all others
    return _tables[p][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def normalized(buf: bytes) -> np.ndarray:
    """The bytes of the words with one space after each, whatever stood between or before them."""
    a = np.frombuffer(buf + b" ", np.uint8)
    sep = _SEP[a]
    keep = ~sep
    keep[1:] |= ~sep[:-1]
    out = a[keep]
    out[sep[keep]] = 32
    return out


def word_ends(norm: np.ndarray) -> np.ndarray:
    """Places of the spaces (or line ends between packed strings) after words in a normalized buffer."""
    return np.flatnonzero((norm == 32) | (norm == 10))


def word_hashes(norm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes; the same word has the same hash in any text."""
    out = np.empty(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    i = 0
    while i < len(ends):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + _PART, side="right")))
        part = norm[lo : ends[j - 1]]
        n = len(part) + 1
        # a long word has a part, and tables, of its own size
        s = np.zeros(n, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_P, n - 1), out=s[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (s[b] - s[a]) * powers(inverse(_P), n)[a]
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + h[j : n + j]
    return mix(out)


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries."""
    span = 1
    while span * 2 <= w:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    return np.minimum(g[: len(g) - (w - span)], g[w - span :]) if w > span else g
