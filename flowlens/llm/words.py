"""Words of many texts at once: cutting and 64-bit hashing in numpy, inside tasks.

A word is a run of characters other than blank and U+0009 to U+000D.  These are
single bytes in UTF-8 and part of no other character, so bytes are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte table that lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK) + 1
        for name, base in (("up", _STEP), ("down", _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Words:
    """The words of a block of texts.

    hashes, start, stop (bytes in data), doc (index of the text in the block),
    first (index of the first word of each text, and one past the last).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None):
        if table is not None:
            data = table[data]
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(opens)
        self.stop = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        up, down = _powers_to(len(data))
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        self._sums, self._down = sums, down
        self.hashes = self.prefix_hash(self.start, self.stop)

    def prefix_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to stop; equal bytes have equal hashes."""
        return mix((self._sums[stop] - self._sums[start]) * self._down[start])

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.stop[i]].tobytes()


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive values; they may reach over the end of a text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:m] * _GRAM[0]
    for k in range(1, n):
        out += hashes[k : k + m] * _GRAM[k]
    return mix(out)


def blocks(texts: pa.Array, table: np.ndarray | None = None) -> Iterator[tuple[int, Words]]:
    """(index of the first text, its Words) for blocks of about BLOCK bytes; null is empty.
    table replaces every byte before words are cut."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, raw, data = texts.buffers()
    offsets = np.frombuffer(raw, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        end = min(end, n)
        yield at, Words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], table)
        at = end
