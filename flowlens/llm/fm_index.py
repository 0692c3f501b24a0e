"""A compressed FM-index over word ids, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletTree:
    """Levels of a balanced wavelet tree, stored as a matrix: one bit vector a level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        # Where each symbol's rows begin on the last level.
        self.base = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            ones = bits.rank(at)
            up = (symbol >> (self.depth - 1 - k)) & 1
            at = np.where(up == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first `at`."""
        return self._descend(symbol, at) - self.base[symbol]


def sorted_suffixes(text: np.ndarray, least: int) -> np.ndarray:
    """Places of the text's suffixes, sorted by at least their first `least` symbols."""
    n, width = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while width < least:
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1 if width < n else 0
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1:
            break
    return order


class FMIndex:
    """Burrows-Wheeler transform of a text of ids from 1 on, 0 being a separator, which ends it.

    Suffixes are sorted by their first symbols only as far as patterns reach,
    which leaves ranges of patterns that long, or shorter, as they are.
    """

    def __init__(self, text: np.ndarray, longest: int):
        self.n_symbols = int(text.max(initial=0)) + 1
        # Sorted one further, so that a pattern's last backward step is sorted too.
        self.order = sorted_suffixes(text, longest + 1)
        self.tree = WaveletTree(text[self.order - 1], self.n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])

    def ranges(self, text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns text[start : start + length], by backward search."""
        symbol = text[start + length - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(length - 2, -1, -1):
            symbol = text[start + k]
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        return low, high


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low:high] for each range; ranges are not empty."""
    table, out = [values], np.empty(len(low), values.dtype)
    level = np.floor(np.log2(high - low)).astype(np.int64)
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            last, half = table[-1], 1 << (k - 1)
            table = [np.minimum(last[: len(last) - half], last[half:])]
        mine = level == k
        out[mine] = np.minimum(table[-1][low[mine]], table[-1][high[mine] - (1 << k)])
    return out
