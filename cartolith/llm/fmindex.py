"""An FM-index over a sequence of symbols: wavelet-tree ranks, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Ranks of symbols, a bit vector for each bit of a symbol (a wavelet tree with its levels laid end to end)."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bits = ((symbols >> bit) & 1).astype(bool)
            zeros = int(len(bits) - bits.sum())
            self.levels.append((bit, BitRank(bits), zeros))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i."""
        low = np.zeros_like(i)
        for bit, ranks, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            ones_low, ones_i = ranks.ones(low), ranks.ones(i)
            low = np.where(one, zeros + ones_low, low - ones_low)
            i = np.where(one, zeros + ones_i, i - ones_i)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at i."""
        out = np.zeros_like(i)
        for bit, ranks, zeros in self.levels:
            one = ranks.get(i).astype(bool)
            out |= one.astype(i.dtype) << bit
            ones = ranks.ones(i)
            i = np.where(one, zeros + ones, i - ones)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the text's suffixes, by doubling the length to which they are ranked."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """text: symbols of 1 and more; positions are found by walks of at most `every` - 1 steps."""

    def __init__(self, text: np.ndarray, largest: int, every: int = 8):
        text = np.concatenate([np.asarray(text, np.int64), [0]])
        order = suffix_array(text)
        self.size = len(text)
        self.tree = Wavelet(text[order - 1], largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        sampled = order % every == 0
        self.sampled, self.places = BitRank(sampled), order[sampled]

    def search(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each phrase's range of suffixes. A phrase is lengths symbols from starts on."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if len(live):
                symbol = symbols[starts[live] + lengths[live] - back].astype(np.int64)
                low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
                high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            known = self.sampled.get(rows[left]).astype(bool)
            hit = left[known]
            out[hit] = self.places[self.sampled.ones(rows[hit])] + steps[hit]
            left = left[~known]
            symbol = self.tree.access(rows[left])
            rows[left] = self.first[symbol] + self.tree.rank(symbol, rows[left])
            steps[left] += 1
        return out
