"""Vectorised word and shingle hashing for the operators that run in Python workers.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text: exactly what ``bytes.split()``
separates.  Hashes are 64-bit.  A word's hash is a polynomial over random byte
codes, taken from prefix sums, so that a block of texts costs a few array passes
instead of a Python object a word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_STATE: dict = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, grown as needed and kept by the worker."""
    if len(_STATE.get("pow", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            p = np.ones(size, U)
            step, done = base, 1
            while done < size:
                p[done : 2 * done] = p[:done] * U(step)
                step, done = step * step & _MASK, 2 * done
            out.append(p)
        _STATE["pow"], _STATE["inv"] = out
    return _STATE["pow"], _STATE["inv"]


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "codes" not in _STATE:
        codes = mix64(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
        low = codes.copy()
        low[65:91] = codes[97:123]
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _STATE["codes"], _STATE["low"], _STATE["space"] = codes, low, space
    return _STATE["codes"], _STATE["low"], _STATE["space"]


def word_hashes(texts: list, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words start (one more at the end).

    ``lower`` folds A-Z only.  None counts as empty.
    """
    codes, low, space = _tables()
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    n = len(buf)
    power, inverse = _powers(n + 1)
    gap = space[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((low if lower else codes)[buf] * power[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts])
    lengths = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return hashes, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, over the borders of texts too."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, U)
    for j in range(k):
        h = mix64(h * U(0x9FB21C651E98DF25) + words[j : j + n])
    return h


def shingle_sets(texts: list, k: int = 5) -> list[np.ndarray]:
    """Each text's distinct k-word shingles, sorted; fewer words make one shingle of them all; none make none."""
    words, at = word_hashes(texts, lower=True)
    h = grams(words, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(grams(words[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, U))
    return out


def blocks(texts: list, most: int = 1 << 21):
    """Slices of ``texts`` of about ``most`` characters, so that working arrays stay small."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
