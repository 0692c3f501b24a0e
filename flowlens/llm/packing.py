"""Best-fit packing by exact-complement hashing.

Pieces of equal length are alike, so the plan is made on the counts by length,
at most `capacity` numbers whatever the corpus: lengths that fill the gap left
by another exactly, alone, as a pair or as a triple, are looked up by their sums
and consumed as long as counts last; what remains is packed best-fit,
longest first.  The plan says for runs of ranks within a length where they go,
and every piece finds its place by its rank.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import written
from flowlens.llm.tokens import Encoder, _texts

#: Rows that are numbered together, about.
NUMBERED = 50_000


class _Plan:
    """Runs: (length, rank from, rank to, first sequence, offset)."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.capacity = counts.copy(), capacity
        self.rank = np.zeros(capacity + 1, np.int64)
        self.sequences, self.runs = 0, []

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        a = int(self.rank[length])
        self.runs.append((length, a, a + n, sequence, offset))
        self.rank[length] += n
        self.left[length] -= n

    def consume(self, lengths: tuple[int, ...]) -> bool:
        """As many sequences of exactly these lengths as counts allow."""
        n = min(int(self.left[x]) // k for x, k in Counter(lengths).items())
        if n <= 0:
            return False
        offset = 0
        for x in lengths:
            self.place(x, n, self.sequences, offset)
            offset += x
        self.sequences += n
        return True


def _pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Lengths b >= c, both left, with b + c = total and b <= most; the largest b."""
    b = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
    ok = b[(left[b] > 0) & (left[total - b] > 0) & ((2 * b != total) | (left[b] > 1))] if len(b) else b
    return (int(ok[0]), total - int(ok[0])) if len(ok) else None


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs for all lengths 1..capacity, and the number of sequences."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    plan = _Plan(have, capacity)
    left = plan.left
    plan.consume((capacity,))
    for a in range(capacity - 1, 0, -1):  # gaps filled by one
        if 2 * a < capacity:
            break
        plan.consume((a, capacity - a))
    for a in range(capacity - 2, 0, -1):  # by a pair
        while left[a] and (p := _pair(left, capacity - a, a)):
            if not plan.consume((a, *p)):
                break
    hopeless = np.zeros(capacity + 1, bool)  # sums that no pair makes any more: counts only fall
    for a in range(capacity - 3, 0, -1):  # by a triple
        if not left[a]:
            continue
        if 4 * a < capacity:
            break
        b = np.arange(min(a, capacity - a - 2), 0, -1)
        for x in b[(left[b] > 0) & ~hopeless[capacity - a - b]].tolist():
            rest = capacity - a - x
            while left[a] and left[x] and not hopeless[rest]:
                p = _pair(left, rest, rest)
                if p is None:
                    hopeless[rest] = True
                elif not plan.consume((a, x, *p)):
                    break
    _best_fit(plan)
    return plan.runs, plan.sequences


def _best_fit(plan: _Plan) -> None:
    """Best-fit decreasing; sequences with equal gaps are kept as ranges."""
    capacity, left = plan.capacity, plan.left
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of sequences
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            open_.setdefault(gap, []).append((first, n))
            gaps[gap] = True

    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, n = open_[gap].pop()
                k = min(n, int(left[length]))
                if k < n:
                    open_[gap].append((first + k, n - k))
                elif not open_[gap]:
                    gaps[gap] = False
                plan.place(length, k, first, capacity - gap)
                put(gap - length, first, k)
                continue
            each = capacity // length
            full, first = int(left[length]) // each, plan.sequences
            n, in_each = (full, each) if full else (1, int(left[length]))
            for j in range(in_each):
                plan.place(length, n, first, j * length)
            plan.sequences += n
            put(capacity - in_each * length, first, n)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document.

    A document's ids end with end_id.  Longer ones are cut into pieces of
    `capacity` ids, the first of which may be shorter.
    """

    def cut(batches):
        encoder, end = Encoder.at(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in _texts(batch, 512):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    stops = range((n - 1) % capacity + 1, n + 1, capacity)
                    start = 0
                    for piece, stop in enumerate(stops):
                        rows.append((doc_id, piece, start, stop - start, ids[4 * start : 4 * stop]))
                        start = stop
                d, p, s, n, i = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces, with sequence_id and offset: every piece placed, gapless from 0.

    pieces has doc_id, piece, length (1 to capacity) and any other columns but
    sequence_id and offset.  They are written down first, as they are read
    twice.  Lengths are numbered in parts, so that one that a third of all
    pieces share is no single group.  Repeated rows are pieces of their own.
    An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_packing(counts, capacity)
    salts = max(16, -(-max(counts.values(), default=1) // NUMBERED))
    # The plan has some thousand rows, bounded by `capacity` and not by the pieces.
    table = F.broadcast(spark.createDataFrame(runs, "_length long, _from long, _to long, _sequence long, _at long"))
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(salts)).cast("int"))
    parts = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1).join(parts, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_before"))
    placed = ranked.join(table, F.expr("length = _length and _rank >= _from and _rank < _to"))
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"),
        F.col("_at").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset of all documents.

    Null texts are empty: one piece, the end id.  Null ids stay null.  Rows that
    repeat an id are packed as often as they come.  Texts of any length are
    packed whole; further columns of docs are not looked at.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
