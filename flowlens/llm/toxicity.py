"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model give every expression, a word without the marks
around it, a probability, letter by letter: the context of a letter is the word
up to it.  Counts of a class are discounted, and what they leave goes to a
backoff that both classes share: continuation counts of short letter sequences
over the different contexts they occur in.  So a rare expression is toxic by its
stem alone, and one that neither class has seen is no evidence.

A document is compared by its log-likelihood ratio, normalised by length: over
the whole text, and in its most toxic expressions.  A logistic curve, fitted on
rows that the counts have not seen, turns the comparison into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowlens.llm.common import written
from flowlens.llm.words import Words, blocks, mix

#: Letters (bytes) of an expression; a longer run is an expression from each of its characters on.
LETTERS = 24
#: Letters that are looked at together, about; counts of letters that wait to be summed up, about.
AT_ONCE, WAITING = 250_000, 1_000_000
DISCOUNT = 0.75
#: The bound of the fit: so many labelled rows of each class, about, drawn by hash.
MOST_ROWS = {1: 8_000, 0: 16_000}
#: Their share that is counted; the rest fits the curve.
COUNTED = 0.6

_ROOT = mix(np.zeros(1, np.uint64))[0]
_LETTER = np.zeros(256, np.uint8) + ord(" ")
for _b in range(256):
    if _b >= 128 or chr(_b).isalpha():
        _LETTER[_b] = _b + 32 if 65 <= _b <= 90 else _b


class Expressions:
    """The expressions of a block: its words, those of more than LETTERS bytes cut into
    overlapping pieces.  As in Words; doc, first as well."""

    def __init__(self, words: Words):
        self.data, self.prefix_hash = words.data, words.prefix_hash
        self.start, self.stop, self.hashes, self.doc, self.first = words.start, words.stop, words.hashes, words.doc, words.first
        long = words.stop - words.start > LETTERS
        if long.any():
            heads = np.flatnonzero((words.data & 0xC0) != 0x80)  # first bytes of characters
            low, high = np.searchsorted(heads, words.start), np.searchsorted(heads, words.stop)
            n = np.where(long, high - low, 1)
            owner = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            self.start = heads[low[owner] + k]
            self.stop = np.minimum(self.start + LETTERS, words.stop[owner])
            self.hashes = words.prefix_hash(self.start, self.stop)
            self.doc = words.doc[owner]
            self.first = np.append(0, np.cumsum(n))[words.first]

    def __len__(self) -> int:
        return len(self.start)

    def parts(self) -> Iterator[tuple[slice, Expressions]]:
        """Runs of expressions of about AT_ONCE letters."""
        step = max(AT_ONCE // LETTERS, 1)
        for a in range(0, len(self), step):
            cut, part = slice(a, a + step), object.__new__(Expressions)
            part.data, part.prefix_hash = self.data, self.prefix_hash
            part.start, part.stop, part.hashes, part.doc = self.start[cut], self.stop[cut], self.hashes[cut], self.doc[cut]
            yield cut, part


def _expressions(words: Expressions):
    """Different expressions of a block: (index of each word's expression, keys and
    parents by letter, tail of two letters and letter by letter, letters, expression by letter)."""
    _, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    start = words.start[at]
    n = words.stop[at] - start
    owner = np.repeat(np.arange(len(at)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = np.repeat(start, n) + k
    key = words.prefix_hash(np.repeat(start, n), place + 1)
    parent = np.where(k > 0, np.roll(key, 1), _ROOT)
    letter, one, two = (words.data[place - back].astype(np.int64) for back in range(3))
    tail = np.where(k > 1, two, 0) * 256 + np.where(k > 0, one, 0)
    return inverse, key, parent, tail, letter, owner, n


def _letters(texts):
    for at, words in blocks(texts, table=_LETTER):
        yield at, Expressions(words)


def _count(batches):
    """key, parent, tail, letter, n0, n1: letters counted by context and class, per task."""
    kinds = (np.uint64, np.uint64, np.uint16, np.uint8, np.int32, np.int32)
    held: list[list[np.ndarray]] = [[] for _ in kinds]
    waiting = 0

    def sum_up():
        # A column at a time, so that no other copy of the rest is held.
        key, at, inverse = np.unique(np.concatenate(held[0]), return_index=True, return_inverse=True)
        held[0] = [key]
        for k, kind in enumerate(kinds[1:], 1):
            column = np.concatenate(held[k])
            held[k] = [column[at] if k < 4 else np.bincount(inverse, column, len(key)).astype(kind)]

    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_pylist(), np.int64)
        for at, words in _letters(batch.column("text")):
            for _, part in words.parts():
                inverse, key, parent, tail, letter, owner, _ = _expressions(part)
                label = toxic[at + part.doc]
                by_class = [np.bincount(inverse[label == c], minlength=inverse.max() + 1)[owner] for c in (0, 1)]
                for column, values, kind in zip(held, (key, parent, tail, letter, *by_class), kinds, strict=True):
                    column.append(values.astype(kind, copy=False))
                waiting += len(key)
                if waiting > WAITING:
                    sum_up()
                    waiting = 0
    if held[0]:
        sum_up()
        for a in range(0, len(held[0][0]), 100_000):
            cut = [x[a : a + 100_000] for (x,) in held]
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in cut], ["key", "parent", "tail", "letter", "n0", "n1"])


class _Lookup:
    """Places of 64-bit keys in a sorted table, by their leading bits."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.first = np.searchsorted(keys, np.arange(2**self.BITS + 1, dtype=np.uint64) << np.uint64(64 - self.BITS)) if len(keys) else None
        if len(keys):
            self.first[-1] = len(keys)
            self.longest = int(np.diff(self.first).max())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        top = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        for k in range(self.longest):
            near = np.minimum(at + k, len(self.keys) - 1)
            out = np.where((at + k < stop) & (self.keys[near] == keys), near, out)
        return out


@dataclass
class Backoff:
    """Shared Kneser-Ney backoff: after two letters, then after none.

    Its counts are of different prefixes, not of occurrences."""

    codes: np.ndarray  # tail * 256 + letter, ascending
    n: np.ndarray  # different prefixes with this tail that the letter follows
    single: np.ndarray  # probability of each letter after nothing
    total: np.ndarray  # by tail
    kinds: np.ndarray  # by tail

    @classmethod
    def of(cls, tail: np.ndarray, letter: np.ndarray, n: np.ndarray) -> Backoff:
        order = np.argsort(tail * 256 + letter)
        tail, letter, n = tail[order], letter[order], n[order].astype(float)
        single = np.bincount(letter, minlength=256) + 0.5  # tails the letter follows
        total = np.bincount(tail, n, 65536)
        return cls(tail * 256 + letter, n, single / single.sum(), total, np.bincount(tail, minlength=65536).astype(float))

    def __call__(self, tail: np.ndarray, letter: np.ndarray) -> np.ndarray:
        one = self.single[letter]
        if not len(self.codes):
            return one
        code = tail * 256 + letter
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        n = np.where(self.codes[at] == code, self.n[at], 0)
        total = self.total[tail]
        some = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * self.kinds[tail] * one) / np.maximum(total, 1)
        return np.where(total > 0, some, one)


@dataclass
class Counts:
    """Letters counted by context and class."""

    keys: np.ndarray  # hashes of prefixes, ascending
    seen: np.ndarray  # 2 x keys
    total: np.ndarray  # 2 x (keys + 1): letters seen after the prefix; the empty prefix is last
    kinds: np.ndarray  # 2 x (keys + 1): different letters after the prefix
    backoff: Backoff

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def ratios(self, words: Expressions) -> np.ndarray:
        """Log-likelihood ratio, toxic to ordinary, of every expression."""
        out = np.empty(len(words))
        for cut, part in words.parts():
            out[cut] = self._ratios(part)
        return out

    def _ratios(self, words: Expressions) -> np.ndarray:
        if "_lookup" not in self.__dict__:
            self._lookup = _Lookup(self.keys)
        inverse, key, parent, tail, letter, owner, n = _expressions(words)
        at = self._lookup.find(key)
        before = np.roll(at, 1)
        before[np.cumsum(n) - n] = len(self.keys)
        back, logs = self.backoff(tail, letter), []
        for c in (0, 1):
            total = np.where(before >= 0, self.total[c][before], 0)
            kinds = np.where(before >= 0, self.kinds[c][before], 0)
            seen = np.where(at >= 0, self.seen[c][at], 0) if len(self.keys) else np.zeros(len(at))
            p = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds * back) / np.maximum(total, 1)
            logs.append(np.log(np.where(total > 0, p, back) + 1e-15))
        return np.bincount(owner, logs[1] - logs[0], len(n))[inverse]


FEATURES = 6


def _features(ratios: np.ndarray, words: Expressions, n_docs: int) -> np.ndarray:
    """Per document: the ratio normalised by length, over all words and over those that are
    more likely toxic; the sum of the latter, by its log; the most toxic expression's
    ratio, the mean of the three most toxic, the log of the number of words."""
    out = np.zeros((n_docs, FEATURES))
    count = np.diff(words.first)
    out[:, 3] = np.log1p(count)
    if len(ratios):
        order = np.lexsort((-ratios, words.doc))
        ranked = ratios[order]
        some = count > 0
        first = words.first[:-1][some]
        out[some, 0] = ranked[first]
        top = [np.where(count[some] > k, ranked[np.minimum(first + k, len(ranked) - 1)], 0) for k in range(3)]
        out[some, 1] = sum(top) / 3
        out[:, 2] = np.bincount(words.doc, ratios, n_docs) / np.maximum(count, 1)
        likely = np.bincount(words.doc, np.maximum(ratios, 0), n_docs)
        out[:, 4], out[:, 5] = np.log1p(likely), likely / np.maximum(count, 1)
    return out


def _document_features(counts: Counts, texts) -> np.ndarray:
    out = []
    for _, words in _letters(texts):
        out.append(_features(counts.ratios(words), words, len(words.first) - 1))
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


@dataclass
class ToxicityModel:
    counts: Counts
    curve: np.ndarray  # weights of the features, and a constant
    mean: np.ndarray
    scale: np.ndarray

    def scores(self, texts) -> np.ndarray:
        x = (_document_features(self.counts, texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton's method."""
    mean, scale = (np.average(x, axis=0, weights=weight), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(FEATURES + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 0.1 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(FEATURES + 1)
        w -= np.linalg.solve(hess, grad)
    return w, mean, scale


def train_toxicity(docs: DataFrame, labels: DataFrame, most_rows: dict[int, int] | None = None, seed: int = 5) -> ToxicityModel:
    """Fits on docs (doc_id, text) with labels (doc_id, toxic); labels other than 1 and 0 are left out.

    The bound of the fit is most_rows labels per class, about, drawn by a hash of
    doc_id, and every prefix in them goes to every task.  All of the drawn
    documents' whole texts are used: COUNTED of them for the counts, which
    Spark sums by context, the rest for the curve.  Without rows of a class
    every score is the share of toxic rows.
    """
    most = most_rows or MOST_ROWS
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    have = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most[c] / max(have.get(c, 0), 1)) for c in (0, 1)}
    u = (F.xxhash64(F.lit(seed), "doc_id", "toxic").bitwiseAND(F.lit(2**40 - 1))) / float(2**40)
    some = labels.withColumn("_u", u / F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).where("_u < 1")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    drawn = written(texts.join(F.broadcast(some), "doc_id").select("text", "toxic", "_u"), "labelled")
    per_task = drawn.where(F.col("_u") < COUNTED).select("text", "toxic").mapInArrow(_count, "key long, parent long, tail long, letter long, n0 long, n1 long")
    table = written(per_task.groupBy("key", "parent", "tail", "letter").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "contexts")
    tails = table.groupBy("tail", "letter").agg(F.count("*").alias("n")).toArrow()  # at most the letter triples
    backoff = Backoff.of(*(tails.column(c).to_numpy() for c in ("tail", "letter", "n")))
    kinds = [F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)]
    sums = [F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)]
    contexts = table.groupBy(F.col("parent").alias("_parent")).agg(*sums, *kinds)
    known = table.join(contexts, F.col("key") == F.col("_parent"), "left").na.fill(0)
    fields = ["n0", "n1", "t0", "t1", "k0", "k1"]
    got = known.select("key", *(F.col(f).cast("int") for f in fields)).orderBy("key").toArrow()  # the prefixes in the drawn rows
    root = contexts.where(F.col("_parent") == int(_ROOT.astype(np.int64))).first()
    key = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    column = {f: got.column(f).to_numpy()[order].astype(np.float32) for f in fields}
    edge = {f: np.float32(root[f] if root else 0) for f in fields[2:]}
    table_of = lambda f: np.stack([np.append(column[f"{f}{c}"], edge[f"{f}{c}"]) for c in (0, 1)])
    counts = Counts(key[order], np.stack([column["n0"], column["n1"]]), table_of("t"), table_of("k"), backoff)
    del got, column
    cast = drawn.sparkSession.sparkContext.broadcast(counts)  # every prefix in the drawn rows

    def features(batches):
        for batch in batches:
            x = _document_features(cast.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, x.T)], ["toxic", *(f"x{k}" for k in range(FEATURES))])

    fields = ", ".join(f"x{k} double" for k in range(FEATURES))
    rest = drawn.where(F.col("_u") >= COUNTED).select("text", "toxic").mapInArrow(features, f"toxic int, {fields}").toPandas()
    cast.unpersist()  # the model, with the same counts, is sent to score
    y = rest["toxic"].to_numpy(float)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    w, mean, scale = _fit_curve(rest.iloc[:, 1:].to_numpy(float), y, weight / max(weight.mean(), 1e-9) if len(y) else weight)
    if y.min(initial=1) == y.max(initial=0):  # one class, or none, to fit on
        toxic = have.get(1, 0) / max(sum(have.values()), 1)
        w = np.append(np.zeros(FEATURES), np.log((toxic + 1e-3) / (1 - toxic + 1e-3)))
    return ToxicityModel(counts, w, mean, scale)


def score_toxicity(docs: DataFrame, model: ToxicityModel, out: str = "toxicity_score") -> DataFrame:
    """docs with a score from 0 to 1 in column `out`, which is replaced if docs has it.

    Whole texts are scored; null texts are empty, and an empty one gets the
    score that the curve gives to no expressions.  Repeated rows get equal
    scores, an empty table an empty one, and no column but text is looked at.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(out)
    at = docs.columns.index("text")

    def score(batches):
        for batch in batches:
            scores = cast.value.scores(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(score, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
