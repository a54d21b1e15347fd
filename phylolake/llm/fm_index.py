"""FM-index over a sequence of small integers: suffix order, wavelet matrix, sampled positions.

Everything is vectorised over the queries: a backward search step or an LF step
of many ranges or rows at once is a few array lookups per bit of the alphabet.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` sorted by suffix (prefix doubling; the end sorts first)."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else new[order]
        rank, step = new, step * 2
        if n == 0 or rank[order[-1]] == n or step >= n:
            return order


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit level after the other."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            self.levels.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol[i]`` occurs before ``end[i]``."""
        lo, hi = np.zeros_like(end), end
        for level, ones in enumerate(self.levels):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            one_lo, one_hi = ones[lo], ones[hi]
            lo = np.where(bit == 1, self.zeros[level] + one_lo, lo - one_lo)
            hi = np.where(bit == 1, self.zeros[level] + one_hi, hi - one_hi)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the given places."""
        value = np.zeros_like(at)
        for level, ones in enumerate(self.levels):
            bit = ones[at + 1] - ones[at]
            value = value * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + ones[at], at - ones[at])
        return value


class FMIndex:
    """Index of a text of non-negative integers; queries give exact occurrences."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        s = np.concatenate([text.astype(np.int64) + 1, [0]])  # a unique end symbol
        order = suffix_order(s)
        last = s[order - 1]
        bits = max(1, int(n_symbols).bit_length())
        self.n, self.wavelet = len(s), WaveletMatrix(last, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n_symbols + 1))]).astype(np.int64)
        kept = order % sample == 0
        self.kept, self.kept_before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases given as a matrix, one phrase of equal length per row."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k].astype(np.int64) + 1
            lo, hi = self.first[c] + self.wavelet.rank(c, lo), self.first[c] + self.wavelet.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: LF steps back to the next sampled position."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            hit = self.kept[at]
            out[todo[hit]] = self.positions[self.kept_before[at[hit]]] + steps
            todo, at, steps = todo[~hit], at[~hit], steps + 1
            if len(todo):
                c = self.wavelet.access(at)
                at = self.first[c] + self.wavelet.rank(c, at)
        return out
