"""FM-index over a shard of integer symbols: wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

BREAK = 0  # ends a run; no phrase holds it
SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array where every BREAK differs from every other, so that order ends at a break."""
    n = len(symbols)
    breaks = symbols == BREAK
    n_breaks = int(breaks.sum())
    rank = symbols.astype(np.int64) + n_breaks
    rank[breaks] = np.arange(n_breaks)
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        steps = np.ones(n, np.int64)
        ordered = rank[order]
        steps[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(steps) - 1
        if not n or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        step *= 2


class WaveletMatrix:
    """rank(c, i): how often c stands among the first i symbols."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for b in self.bits:
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            before = ones[i]
            i = np.where((c >> b) & 1, zeros + before, i - before)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(c, i) - self.base[c]


class FmIndex:
    def __init__(self, symbols: np.ndarray, sigma: int):
        symbols = np.concatenate([symbols, [BREAK]]).astype(np.int64)
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.last = before
        self.wavelet = WaveletMatrix(before, sigma)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # A position after a break is sampled too: walks back never have to cross a break.
        kept = (order % SAMPLE == 0) | (before == BREAK)
        self.sampled = np.where(kept, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of equally long phrases (one a row), symbol by symbol from the end."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.last), np.int64)
        for column in phrases.T[::-1]:
            lo = self.below[column] + self.wavelet.rank(column, lo)
            hi = self.below[column] + self.wavelet.rank(column, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of every row: steps back until a sampled position."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = self.sampled[at]
        open_ = np.flatnonzero(out < 0)
        while len(open_):
            c = self.last[at[open_]]
            at[open_] = self.below[c] + self.wavelet.rank(c, at[open_])
            steps[open_] += 1
            out[open_] = self.sampled[at[open_]]
            open_ = open_[out[open_] < 0]
        return out + steps
