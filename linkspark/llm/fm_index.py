"""An FM-index over integer sequences: suffix array, wavelet-tree ranks, backward search, sampled suffix positions.

All steps are whole-array numpy operations; many patterns are searched and many occurrences located at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. text: symbols 1.., and 0 as a separator; each separator is unlike any other,
    ordered by place, and below all symbols, so no match runs across one."""
    n = len(text)
    is_sep = text == 0
    first = int(is_sep.sum())
    rank = np.where(is_sep, np.cumsum(is_sep) - 1, text.astype(np.int64) + first)
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        at = rank[order]
        new = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        if width < n:
            after[:-width] = rank[width:] + 1
        rank = rank * (n + 1) + after
        width *= 2
        order = np.argsort(rank, kind="stable")


class WaveletTree:
    """Ranks of symbols over a sequence. Levels are stored whole, zeros before ones (the levelwise layout)."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        cur = seq
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(cur) - int(bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` ends up at the lowest level, following the bits of ``symbol``."""
        for ones, zeros, level in zip(self.ones, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            r = ones[place]
            place = np.where((symbol >> level) & 1, zeros + r, place - r)
        return place

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and where they end up."""
        symbol = np.zeros(len(place), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            r = ones[place]
            bit = ones[place + 1] - r
            symbol = symbol * 2 + bit
            place = np.where(bit, zeros + r, place - r)
        return symbol, place


class FMIndex:
    """text: int array of symbols 1..top with 0 as separators; it must end with a separator."""

    def __init__(self, text: np.ndarray, top: int, every: int = 8):
        self.n = len(text)
        sa = suffix_array(text)
        before = text[sa - 1]  # place -1 is the closing separator, before the first suffix
        self.tree = WaveletTree(before.astype(np.int64), top)
        counts = np.bincount(text, minlength=top + 1)
        self.starts = np.concatenate(([0], np.cumsum(counts)))[: top + 1]
        symbols = np.arange(top + 1)
        self.bases = self.tree.descend(symbols, np.zeros(top + 1, np.int64))
        marked = (sa % every == 0) | (before == 0)  # never step over a separator
        self.marked = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.samples = sa[marked]

    def _step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.tree.descend(symbol, place) - self.bases[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one row each, all of one length. Row ranges [lo, hi) of the suffixes that begin with each."""
        m, length = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(length - 1, -1, -1):
            c = patterns[live, j]
            lo[live], hi[live] = self._step(c, lo[live]), self._step(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows, by stepping back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        rows = rows.copy()
        while len(live):
            found = self.marked[rows[live]]
            at = live[found]
            out[at] = self.samples[self.mark_rank[rows[at]]] + steps
            live = live[~found]
            if len(live):
                symbol, low = self.tree.access(rows[live])
                rows[live] = self.starts[symbol] + low - self.bases[symbol]
            steps += 1
        return out
