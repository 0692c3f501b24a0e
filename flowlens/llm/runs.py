"""Periodic runs of words: maximal repetitions of whole texts, and texts without them.

A run is a stretch of words with smallest period q that no neighbouring word
extends.  Every run holds a longest Lyndon word of length q in one of the two
orders of the words, so one stack of Lyndon words per order, scanned from the
right, and one extension to both sides of each word give all runs.  Suffixes are
compared and words extended by longest common extensions, found by binary search
over rolling hashes; what is reported has been compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The prime field of the rolling hash, and its base.
FIELD = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % FIELD
#: Words compared one by one before hashes are.
NEAR = 4
_powers = [1]


def _powers_to(n: int) -> list[int]:
    while len(_powers) <= n:
        _powers.append(_powers[-1] * BASE % FIELD)
    return _powers


class Extensions:
    """Longest common extensions between places of a list of word numbers."""

    def __init__(self, words: list[int]):
        self.words, self.n, self.powers = words, len(words), _powers_to(len(words))
        sums, total = [0], 0
        for w in words:
            total = (total * BASE + w + 1) % FIELD
            sums.append(total)
        self.sums = sums

    def _same(self, i: int, j: int, size: int) -> bool:
        s = self.sums
        return (s[i + size] - s[j + size] - (s[i] - s[j]) * self.powers[size]) % FIELD == 0

    def ahead(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        w, most = self.words, self.n - j
        for k in range(min(NEAR, most)):
            if w[i + k] != w[j + k]:
                return k
        return self._search(most, lambda size: self._same(i, j, size))

    def back(self, i: int, j: int) -> int:
        """How many words up to i equal those up to j, read to the left; i < j."""
        w, most = self.words, i + 1
        for k in range(min(NEAR, most)):
            if w[i - k] != w[j - k]:
                return k
        return self._search(most, lambda size: self._same(i + 1 - size, j + 1 - size, size))

    @staticmethod
    def _search(most: int, same) -> int:
        """The largest size up to most that is the same, by doubling and halving; NEAR or all are known to be."""
        low = high = min(NEAR, most)
        while low < most:
            high = min(2 * low, most)
            if not same(high):
                break
            low = high
        while high - low > 1:
            middle = (low + high) // 2
            if same(middle):
                low = middle
            else:
                high = middle
        return low


def _lyndon_words(e: Extensions, upwards: bool) -> Iterator[tuple[int, int, int]]:
    """(i, j, common): the longest Lyndon word from each i ends before j; common words of both suffixes.

    The stack holds the starts of ever smaller suffixes to the right; the end
    of the text is smaller than any word in either order.
    """
    w, n, ahead = e.words, e.n, e.ahead
    stack = [n]
    for i in range(n - 1, -1, -1):
        common = 0
        while (j := stack[-1]) < n:
            a, b = w[i], w[j]
            if a == b:
                common = ahead(i, j)
                if j + common == n:
                    break
                a, b = w[i + common], w[j + common]
            else:
                common = 0
            if (a > b) == upwards:
                break
            stack.pop()
        yield i, j, common if j < n else 0
        stack.append(i)


def runs_of(words: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(min_length, min_exponent * period) words, ascending.

    words are numbers, equal for equal words; min_exponent is 2 at least.
    """
    e, found, latest = Extensions(words), {}, {}
    for upwards in (True, False):
        for i, j, common in _lyndon_words(e, upwards):
            period = j - i
            start, stop = latest.get(period, (0, 0))
            if start <= i and j < stop:
                continue  # in a run that is known
            before = e.back(i - 1, j - 1) if i and j <= e.n and words[i - 1] == words[j - 1] else 0
            if period + before + common >= max(min_length, min_exponent * period):
                found[i - before, period] = period + before + common
                latest[period] = i - before, j + common
    for (start, period), length in found.items():  # the hashes have the last word nowhere
        stop = start + length
        if words[start : stop - period] != words[start + period : stop] or stop < e.n and words[stop] == words[stop - period] or start and words[start - 1] == words[start + period - 1]:
            return _by_comparison(words, min_length, min_exponent)
    return sorted((start, length, period) for (start, period), length in found.items())


class _Plain(Extensions):
    """The same by comparison alone."""

    def _same(self, i: int, j: int, size: int) -> bool:
        return self.words[i : i + size] == self.words[j : j + size]


def _by_comparison(words: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """For a text on which the hashes failed."""
    e, found = _Plain(words), set()
    for upwards in (True, False):
        for i, j, common in _lyndon_words(e, upwards):
            before = e.back(i - 1, j - 1) if i else 0
            if j - i + before + common >= max(min_length, min_exponent * (j - i)):
                found.add((i - before, j - i + before + common, j - i))
    return sorted(found)


def stretches(ids: np.ndarray, min_length: int, min_exponent: int) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that may hold a run, ascending; no run reaches out of its stretch.

    A run of L >= max(min_length, min_exponent * q) words holds each of its
    words min_exponent times.  It holds L - 2 starts of three words, which
    repeat every q: each of them comes at least min_exponent - 1 times where q
    is 2 or more, and max(min_length, min_exponent) - 2 times where q is 1.
    So rarer words and triples bound the runs, whatever stands there.
    """
    n, shortest = len(ids), max(min_length, min_exponent)
    live = np.bincount(ids)[ids] >= min_exponent
    out = [(start, stop) for start, stop in _true_ranges(live) if stop - start >= shortest]
    least = min(min_exponent - 1, shortest - 2)
    if least < 2 or not out:
        return out
    at = np.concatenate([np.arange(a, b - 2) for a, b in out])
    _, pairs = np.unique(ids[at].astype(np.int64) * n + ids[at + 1], return_inverse=True)
    _, triples, count = np.unique(pairs.astype(np.int64) * n + ids[at + 2], return_inverse=True, return_counts=True)
    often = np.zeros(n, bool)
    often[at[count[triples] >= least]] = True
    return [(a, b + 2) for a, b in _true_ranges(often) if b + 2 - a >= shortest]


def _true_ranges(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def text_runs(words: list[bytes], min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    n = len(words)
    if n < min_length:
        return []
    last = dict(zip(words, range(n)))  # noqa: B905
    if n - len(last) < min_exponent - 1:
        return []  # no word comes min_exponent times
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    found = []
    for start, stop in stretches(ids, min_length, min_exponent):
        found += [(start + a, size, q) for a, size, q in runs_of(ids[start:stop].tolist(), min_length, min_exponent)]
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    out, at = [], 0
    for start, stop in sorted((a + q, a + size) for a, size, q in runs):
        if stop > at:
            out += words[at : max(at, start)]
            at = stop
    return out + words[at:]


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, digest_only: bool = False) -> DataFrame:
    """docs with `n_words` long, `runs` (start, length, period; by start, then period) and `collapsed`.

    Words are runs of other bytes than blank and U+0009 to U+000D, numbered from
    0.  A run is a stretch with smallest period q of max(min_length,
    min_exponent * q) words or more that no neighbouring word extends keeping
    the period; min_exponent is an integer of 2 or more.  collapsed is the words
    joined by one blank, without those that any run holds behind its first q
    words; with digest_only it is the text's lower-case hex sha256 instead.

    Null and empty texts have no words, no runs and an empty collapsed text.
    Rows are taken by themselves, so repeated rows, ties and null ids change
    nothing, and nothing is shuffled.  Columns of docs named like the three new
    ones are replaced; all others pass through.  A text is held whole in one
    task with some 10 bytes a byte; texts are not cut.
    """
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    new = ["n_words", "runs", "collapsed"]
    own = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            counts, runs, collapsed = [], [], []
            for text in texts:
                words = (text.as_py() or b"").split()
                found = text_runs(words, min_length, min_exponent)
                kept = b" ".join(kept_words(words, found))
                counts.append(len(words))
                runs.append([{"start": a, "length": size, "period": q} for a, size, q in found])
                collapsed.append(hashlib.sha256(kept).hexdigest() if digest_only else kept)
            kept = pa.array(collapsed, pa.string() if digest_only else pa.binary()).cast(pa.string())
            run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(counts, pa.int64()), pa.array(runs, run), kept], ["row", *new])

    found = rows.mapInArrow(find, f"row {row_type}, n_words long, runs {RUNS}, collapsed string")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in own], *new)


def longest_run(runs) -> object:
    """Of an array of runs the one with the greatest length; ties by smallest start, then period."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def run_lines(runs) -> object:
    """`start,length,period` and a line feed for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.array_join(lines, "")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs where, of every tenth document by h = crc32 of its decimal id, the words from a on repeat with period p.

    g = floor(h / 10), a = g % n of n words, p = 1 + floor((n - a) / (3 + g % 8)).
    Such texts are their words joined by one blank; texts without words stay.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    planted = F.when((h % 10 == 0) & F.col("text").isNotNull(), words)
    df = docs.withColumns({"_words": planted, "_g": F.floor(h / 10)})
    n = F.size("_words")
    a = (F.col("_g") % n).cast("int")
    df = df.withColumns({"_a": F.when(n > 0, a), "_p": F.when(n > 0, (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int"))})
    rest = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    copies = F.floor((n - F.col("_a")) / F.col("_p")).cast("int") + 1
    tail = F.slice(F.flatten(F.array_repeat(rest, copies)), 1, n - F.col("_a"))
    text = F.array_join(F.concat(F.slice("_words", 1, F.col("_a")), tail), " ")
    return df.withColumn("text", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text"))).drop("_words", "_g", "_a", "_p")
