"""FM-index over a shard of integer symbols.

A shard is a row of runs, each closed by a separator. Symbols are 1..sigma; the separators
count as 0 for searching and sort by their place. Ranks over the Burrows-Wheeler transform
come from a wavelet matrix, and every ``step``-th suffix position, with the first of each
run, is kept for locating.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """rank(symbol, i): how often a symbol occurs before i."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(i), i
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = (symbol >> level) & 1 == 1
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """By prefix doubling; keys are such that no suffix is a prefix of another."""
    n, width = len(keys), 1
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        moved = np.empty(n, np.int64)
        moved[0] = 0
        np.cumsum(pair[order][1:] != pair[order][:-1], out=moved[1:])
        rank = np.empty(n, np.int64)
        rank[order] = moved
        if moved[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, step: int = 16):
        """symbols: runs of 1..sigma, each followed by one 0."""
        n = len(symbols)
        separators = symbols == 0
        keys = symbols + n
        keys[separators] = np.arange(int(separators.sum()))
        order = suffix_array(keys)
        self.bwt = symbols[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        after_separator = np.concatenate([[True], separators[:-1]])
        self.sampled = ((order % step) == 0) | after_separator[order] | separators[order]
        self.place = np.where(self.sampled, order, 0)
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pattern numbers that occur and their suffix ranges.

        patterns: one row each, read from its end, so column 0 holds the last symbol.
        """
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        found = []
        for k in range(patterns.shape[1] if len(patterns) else 0):
            ended = lengths[which] == k
            if ended.any():
                found.append((which[ended], low[ended], high[ended]))
                which, low, high = which[~ended], low[~ended], high[~ended]
            symbol = patterns[which, k]
            low = self.before[symbol] + self.wavelet.rank(symbol, low)
            high = self.before[symbol] + self.wavelet.rank(symbol, high)
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
            if not len(which):
                break
        found.append((which, low, high))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows: step back through the transform to a kept position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.before[symbol] + self.wavelet.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.place[rows] + steps
