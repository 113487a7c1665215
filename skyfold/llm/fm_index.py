"""A compressed FM-index over integer sequences, searched for many patterns at once.

The Burrows-Wheeler transform lies in a wavelet matrix of packed bits with a
count for every 64: about log2(alphabet) * 2 bits a symbol.  Suffixes that agree
in their first ``width`` symbols stand together in a class; a bitmap with counts
marks where each begins, and each class holds its first place and the least of
the values given for its suffixes.  The suffix array itself is not kept; building
needs some eight working arrays of 64-bit numbers, one entry a symbol.  Suffixes
are sorted by their first ``CONTEXT`` symbols only, which is exact for patterns
shorter than that.  All searches are vectorised over the patterns.
"""

from __future__ import annotations

import numpy as np

CONTEXT = 64


class Bits:
    """A bitmap; rank(i): ones before i."""

    def __init__(self, one: np.ndarray):
        packed = np.packbits(one, bitorder="little")
        self.bits = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        self.counts = np.zeros(len(self.bits) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.bits), out=self.counts[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.counts[word] + np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class WaveletMatrix:
    """rank(symbol, i): occurrences of the symbol before position i."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        x = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            one = (x >> level) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(self.n - int(one.sum()))
            x = np.concatenate([x[~one], x[one]])
        self.start = self._map(np.arange(sigma), np.zeros(sigma, np.int64))

    def _map(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].rank(i)
            one = (symbols >> (self.levels - 1 - k)) & 1 == 1
            i = np.where(one, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._map(symbols, i) - self.start[symbols]


def _dense(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    step = np.zeros(len(keys), np.int64)
    s = keys[order]
    step[1:] = np.cumsum(s[1:] != s[:-1])
    out = np.empty(len(keys), np.int64)
    out[order] = step
    return out


class FMIndex:
    """Index of ``text``, symbols from 1; 0 separates pieces.

    ``width`` is the length of the windows of interest; ``minima`` has for each
    class of them the least of ``values`` (by text position).
    """

    def __init__(self, text: np.ndarray, width: int, values: np.ndarray):
        if not 2 <= width < CONTEXT:
            raise ValueError(f"windows of 2 to {CONTEXT - 1} symbols only")
        n = len(text)
        sigma = int(text.max(initial=0)) + 1
        rank, h, half = text.astype(np.int64), 1, None
        while h < CONTEXT:
            if h <= width < 2 * h:
                half, length = rank, h
            after = np.zeros(n, np.int64)
            after[: max(0, n - h)] = rank[h:] + 1
            keys = rank * (n + sigma + 2) + after
            order = np.argsort(keys, kind="stable" if n < 1000 else None)
            rank = _dense(keys, order)
            h *= 2
        self.counts = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.counts[1:])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.n, self.width, self.sigma = n, width, sigma
        # Suffixes that agree in their first `width` symbols stand together: the first of each such class, and each one's class.
        other = np.minimum(np.arange(n) + width - length, n - 1)
        a, b = half[order], half[other[order]]
        head = np.ones(n, bool)
        head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(head)
        self.minima = np.minimum.reduceat(values[order], heads) if n else values
        self.edges = np.append(heads, n).astype(np.int32 if n < 2**31 else np.int64)
        self.heads = Bits(head)

    def class_of(self, suffix: np.ndarray) -> np.ndarray:
        """The class of the suffix at each place of the order."""
        return self.heads.rank(suffix + 1) - 1

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes of a symbol before those of [lo, hi)."""
        base = self.counts[symbols]
        return base + self.bwt.rank(symbols, lo), base + self.bwt.rank(symbols, hi)

    def own_windows(self, symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        """(piece, offset, class) of every window of pieces that are part of the index.

        ``symbols`` holds the pieces; piece k ends before ``ends[k]``.  From right
        to left, a match of ``width`` symbols is extended by one and then widened
        to all suffixes that share its first ``width``: the matching statistics
        up to that length.
        """
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        longest = int(lengths.max(initial=0))
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[order], lengths[order]
        for t in range(1, longest + 1):
            m = int(np.searchsorted(-lengths, -t, "right"))
            lo, hi = self.extend(lo[:m], hi[:m], symbols[ends[:m] - t])
            if t >= self.width:
                c = self.class_of(lo)
                lo, hi = self.edges[c].astype(np.int64), self.edges[c + 1].astype(np.int64)
                yield order[:m], lengths[:m] - t, c

    def find_windows(self, windows: np.ndarray) -> np.ndarray:
        """The class of each row of ``width`` symbols, -1 where it does not occur."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        alive = np.arange(len(windows))
        for k in range(windows.shape[1] - 1, -1, -1):
            s = windows[alive, k]
            known = (s > 0) & (s < self.sigma)
            alive, s, lo, hi = alive[known], s[known], lo[known], hi[known]
            lo, hi = self.extend(lo, hi, s)
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        out = np.full(len(windows), -1)
        out[alive] = self.class_of(lo)
        return out
