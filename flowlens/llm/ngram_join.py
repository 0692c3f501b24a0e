"""N-gram Jaccard join: rare-first prefix filtering, every pair verified once.

Equal sets are one set from the start.  Shingles are ordered rare first, by
counts of all shingles in hashed cells, then by hash: any one order for all
sets gives right results, a rare-first one few candidates, as long as the cells grow with the texts.  Two sets of similarity 3/4
share a shingle among the first n/4 + 1 of the longer and n/7 + 1 of the shorter;
sets meet by these, and length, position and suffix bounds (by the sizes of the sets' parts) drop
pairs that cannot reach it before any text is read.

A group of similar sets is found by few of its links: in sets that share a shingle,
first neighbours in a few orders are verified, which joins most of a group.  Sets
of different groups that still share a shingle are verified after that, so none is lost:
pair by pair where few share it, else in blocks (set_blocks), as are the links within
groups, which are counted and not written down.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import partitions, with_hot_key, written
from flowlens.llm.components import components
from flowlens.llm.packed import PACKED, heads, packed, spread, split_by, squeezed, unpacked, unsqueezed
from flowlens.llm.set_blocks import compared, required
from flowlens.llm.words import LOWER, Words, blocks, grams, mix

#: Similarity is at least NUM / DEN.
NUM, DEN = 3, 4
#: Bytes of text for each cell that shingles are counted in; bits of the fewest and of the most cells' number, and of a part of them.
LETTERS, FEWEST_BITS, MOST_BITS, PART_BITS = 400, 20, 26, 18
CELLS = 1 << FEWEST_BITS
#: Shingles that a task holds at most before it counts them.
COUNTED = 8_000_000
#: Shingles of a bucket, about.
BUCKET = 3_000_000
#: Sets sharing a shingle: up to so many, all pairs are verified at once.
FEW = 6
#: Orders in which neighbours among more sets are verified first.
ORDERS = 8
#: Shingles of a cell: more are dealt to several buckets, by the sets that hold them.
HOT = 1 << 20
#: Sets sharing a shingle after that: up to so many, pair by pair; more, in blocks.
PAIRWISE = 32
#: Records of sets that are compared in blocks together, about.
TOGETHER = 100_000
#: Records that a task holds at most before it sends them.
HELD = 1_000_000
#: Ids that are sent to all tasks, and those of a partition that are hashed; more are sorted.
SENT, HASHED = 200_000, 1_000_000


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the n-word shingles; shorter documents are one shingle."""
    g = grams(words.hashes, n)
    whole = np.flatnonzero(words.doc[: len(g)] == words.doc[n - 1 :]) if len(g) else np.empty(0, np.int64)
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    single = np.empty(len(short), np.uint64)
    for k in range(1, n):
        mine = np.flatnonzero(count[short] == k)
        if len(mine):
            single[mine] = mix(grams(words.hashes, k)[words.first[short[mine]]] + np.uint64(k))
    return np.concatenate([g[whole], single]), np.concatenate([words.doc[whole], short])


def _sets(words: Words, n: int, rank: np.ndarray | None):
    """Distinct shingles by document: (hashes, sizes), rare first or, without rank, by hash."""
    h, doc = shingles(words, n)
    order = np.lexsort((h, doc)) if rank is None else np.lexsort((h, rank[h & np.uint64(len(rank) - 1)], doc))
    h, doc = h[order], doc[order]
    keep = heads(h) | heads(doc)
    h, doc = h[keep], doc[keep]
    return h, np.bincount(doc, minlength=len(words.first) - 1)


def _set_ids(h: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit id of each set, the same in any order; 0 for empty sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(7 + 1000 * seed)))])
    stop = np.cumsum(size)
    ids = mix((total[stop] - total[stop - size]) + mix(size.astype(np.uint64)))
    return np.where(size > 0, ids, np.uint64(0)).view(np.int64)


def _cells(docs: DataFrame) -> int:
    """How many cells shingles are counted in: a power of two that grows with the texts, so that a cell holds few, whatever the corpus."""
    letters = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << min(max(FEWEST_BITS, (letters // LETTERS).bit_length()), MOST_BITS)


def _cell_counts(docs: DataFrame, n: int, cells: int) -> tuple[np.ndarray, int]:
    """Codes (a byte, rising with the count) of the shingles of all texts by cell, and the number of all shingles."""

    def count(batches):
        held, size = [], 0

        def send():
            at = np.concatenate(held)
            held.clear()
            rows = []
            for part, (mine,) in split_by(at >> PART_BITS, at):
                counts = np.bincount(mine & ((1 << PART_BITS) - 1), minlength=1 << PART_BITS).astype("<u4")
                # By bytes of the same worth: high ones are nearly all 0.
                rows.append((part, squeezed([counts.view(np.uint8).reshape(-1, 4).T])))
            return packed(0, rows)

        for batch in batches:
            for _, words in blocks(batch.column("text"), LOWER):
                h, _ = shingles(words, n)
                held.append((h & np.uint64(cells - 1)).astype(np.int32))
                size += len(h)
                if size > COUNTED:
                    yield send()
                    size = 0
        if held:
            yield send()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << PART_BITS, np.int64)
        for (data,) in table.column("data").to_pylist():
            total += np.ascontiguousarray(np.frombuffer(unsqueezed(data), np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
        return pa.table({"part": table.column("bucket")[:1], "n": [int(total.sum())], "data": pa.array([_coded(total).tobytes()], pa.binary())})

    some = docs.select("text").mapInArrow(count, PACKED)
    rows = written(some.groupBy("bucket").applyInArrow(add, "part long, n long, data binary"), "counts").collect()  # a byte a cell
    out = np.zeros((-(-cells >> PART_BITS), 1 << PART_BITS), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["data"], np.uint8)
    return out.reshape(-1)[:cells], sum(r["n"] for r in rows)


def _coded(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes, eight to an octave."""
    return np.minimum(np.log2(counts + 1.0) * 8, 255).astype(np.uint8)


_DECODED = (2 ** (np.arange(256) / 8)).astype(np.int64) - 1


def _times(rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How often shingles of the same cells come; rank has counts or, as bytes, their codes."""
    at = rank[h & np.uint64(len(rank) - 1)]
    return _DECODED[at] if rank.dtype == np.uint8 else at


def _may_match(n1, p1, n2, p2):
    """Length, prefix and position bounds for sets that share a shingle at places p1, p2."""
    first = n1 <= n2
    small, large = np.where(first, n1, n2), np.where(first, n2, n1)
    at = np.where(first, p1, p2)
    # Of two equal sizes either prefix will do, so both places may count.
    at = np.where(n1 == n2, np.minimum(p1, p2), at)
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - 1 - p1, n2 - 1 - p2)
    return (DEN * small >= NUM * large) & (at <= small // 7) & (most >= required(n1, n2))


#: Parts of a set's members, by hash, whose sizes' last bits are kept; and 64-bit words of these.
BITS = 1024


def _bitmaps(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last bits of the sizes of a set's parts, in 64-bit words.

    In every part where two sets differ in this, a member is in only one of them.
    """
    owner = np.repeat(np.arange(len(size)), size)
    part = ((h >> np.uint64(40)) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(owner * BITS + part, minlength=BITS * len(size)) & 1
    return np.packbits(odd.astype(bool).reshape(-1, BITS), axis=1, bitorder="little").view("<i8").reshape(-1, BITS // 64)


BITMAP = [f"b{k}" for k in range(BITS // 64)]


def _set_table(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """doc_id, text_hash, set_id, a second id of the set, its size and bitmap of every document."""

    def build(batches):
        for batch in batches:
            for at, words in blocks(batch.column("text"), LOWER):
                h, size = _sets(words, n, None)
                own = [batch.column(c).slice(at, len(size)) for c in ("doc_id", "text_hash")]
                ids = [pa.array(_set_ids(h, size, k)) for k in (seed, seed + 1)]
                bits = [pa.array(np.ascontiguousarray(b)) for b in _bitmaps(h, size).T]
                yield pa.RecordBatch.from_arrays([*own, *ids, pa.array(size.astype(np.int32)), *bits], ["doc_id", "text_hash", "set_id", "again", "size", *BITMAP])

    return rows.mapInArrow(build, "doc_id long, text_hash long, set_id long, again long, size int, " + ", ".join(f"{b} long" for b in BITMAP))


def _buckets(h: np.ndarray, e: np.ndarray, rank: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each record: by shingle, those of hot cells by set as well."""
    salt = mix(e.view(np.uint64)) % (_times(rank, h) // HOT + 1).astype(np.uint64)
    return (mix(h + salt) % np.uint64(buckets)).astype(np.int64)


def _prefixes(rows: DataFrame, n: int, seed: int, rank, buckets: int) -> DataFrame:
    """(hash, set, size, place) of all prefixes, by bucket of the hash."""

    def cut(batches):
        held, seen = [], set()

        def send():
            h, e, size, place = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            parts = split_by(_buckets(h, e, rank.value, buckets), h, e, size, place)
            return packed(0, list(parts))

        for batch in batches:
            for _, words in blocks(batch.column("text"), LOWER):
                h, size = _sets(words, n, rank.value)
                ids = _set_ids(h, size, seed)
                # Copies in a task have one prefix.
                fresh = np.zeros(len(ids), bool)
                for i, e in enumerate(ids.tolist()):
                    if e and e not in seen:
                        seen.add(e)
                        fresh[i] = True
                place = spread(size)
                mine = np.repeat(fresh, size) & (place <= np.repeat(size // DEN, size))
                owner = np.repeat(np.arange(len(size)), size)[mine]
                held.append((h[mine], ids[owner], size[owner].astype(np.int32), place[mine].astype(np.int32)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield send()
            if len(seen) > HELD:
                seen.clear()
        if held:
            yield send()

    return rows.select("text").mapInArrow(cut, PACKED)


def _met(rank, pair_buckets: int):
    few, orders = FEW, ORDERS  # as the driver has them
    return lambda table: _first_pairs(table, rank.value, pair_buckets, few, orders)


def _first_pairs(table: pa.Table, rank: np.ndarray, pair_buckets: int, few: int = FEW, orders: int = ORDERS) -> pa.Table:
    """kind 0: pairs to verify first, by bucket of the pair; kind 1: sets by shared shingle, where pairs are left."""
    h, e, size, place = unpacked(table, np.uint64, np.int64, np.int32, np.int32)
    order = np.lexsort((e, size, h))
    h, e, size, place = h[order], e[order], size[order].astype(np.int64), place[order].astype(np.int64)
    keep = heads(h) | heads(e)
    h, e, size, place = h[keep], e[keep], size[keep], place[keep]
    start = np.flatnonzero(heads(h))
    count = np.diff(np.append(start, len(h)))
    hot = _times(rank, h[start]) >= HOT  # others of the shingle are in other buckets
    some = (count > 1) | hot
    many = np.repeat(some, count)
    h, e, size, place = h[many], e[many], size[many], place[many]
    hot, count = hot[some], count[some]
    group = np.repeat(np.arange(len(count)), count)
    number = np.repeat(count, count)
    pairs = [np.empty((2, 0), np.int64)]

    def add(a, b):
        ok = (e[a] != e[b]) & _may_match(size[a], place[a], size[b], place[b])
        a, b = e[a[ok]], e[b[ok]]
        pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))

    for step in range(1, few):  # all pairs of few sets, neighbours by size of many
        a = np.arange(len(h) - step) if len(h) > step else np.empty(0, np.int64)
        same = (group[a] == group[a + step]) & ((number[a] <= few) | (step == 1))
        add(a[same], a[same] + step)
    big = np.flatnonzero(number > few)
    for seed in range(orders):  # neighbours in further orders, the same for all shingles
        key = mix(e[big].view(np.uint64) ^ mix(np.full(1, seed + 1, np.uint64)))
        other = big[np.lexsort((key, group[big]))]
        same = group[other[:-1]] == group[other[1:]]
        add(other[:-1][same], other[1:][same])
    found = np.unique(np.concatenate(pairs, axis=1), axis=1)
    left = (number > few) | np.repeat(hot, count)
    return pa.Table.from_batches([
        packed(0, list(split_by((mix(found[0].view(np.uint64)) % np.uint64(pair_buckets)).astype(np.int64), *found))),
        packed(1, [(0, [h[left], e[left], size[left].astype(np.int32), place[left].astype(np.int32)])]),
    ])


def _different(table: pa.Table) -> pa.Table:
    """The different pairs of a bucket."""
    pairs = np.unique(np.stack(unpacked(table, np.int64, np.int64)), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _rows(packed_rows: DataFrame, fields: list[tuple[str, type, str]]) -> DataFrame:
    """Packed records as rows: (name, numpy type, SQL type) by column."""

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                arrays = unpacked(batch.slice(k, 1), *(t for _, t, _ in fields))
                for a in range(0, len(arrays[0]), 50_000):
                    cut = [x[a : a + 50_000] for x in arrays]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cut], [f for f, _, _ in fields])

    return packed_rows.select("data").mapInArrow(unpack, ", ".join(f"{name} {sql}" for name, _, sql in fields))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Exact test of two ascending sets, after a suffix bound: split by the quartiles of
    one, the sets share in each part at most the smaller part."""
    need = required(len(x), len(y))
    cuts = x[[len(x) // 4, len(x) // 2, 3 * len(x) // 4]]
    a = np.diff(np.concatenate([[0], np.searchsorted(x, cuts), [len(x)]]))
    b = np.diff(np.concatenate([[0], np.searchsorted(y, cuts), [len(y)]]))
    if np.minimum(a, b).sum() < need:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= need


def _only(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members that sets (set_id) name."""
    sets = sets.distinct()
    return members.join(F.broadcast(sets) if sets.count() <= SENT else sets, "set_id", "left_semi")


def _verified(pairs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar, by their members' texts (set_id, text)."""

    def sets(texts) -> list[np.ndarray]:
        out = []
        for _, words in blocks(texts, LOWER):
            h, size = _sets(words, n, None)
            out += np.split(h, np.cumsum(size)[:-1])
        return out

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ok = pa.array([_similar(x, y) for x, y in zip(sets(some.column("x")), sets(some.column("y")), strict=True)], pa.bool_())
                yield some.select(["a", "b"]).filter(ok)

    members = _only(members, pairs.select(F.explode(F.array("a", "b")).alias("set_id")))
    left = members.select(F.col("set_id").alias("a"), F.col("text").alias("x"))
    right = members.select(F.col("set_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _contents(members: DataFrame, n: int) -> DataFrame:
    """e, data: the ascending shingles of every set."""

    def build(batches):
        for batch in batches:
            for at, words in blocks(batch.column("text"), LOWER):
                h, size = _sets(words, n, None)
                stop = np.cumsum(size)
                data = [h[a:b].tobytes() for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("set_id").slice(at, len(size)), pa.array(data, pa.binary())], ["e", "data"])

    return members.select("set_id", "text").mapInArrow(build, "e long, data binary")


def _members(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, text of one document of each wanted set; texts take less room than sets."""
    one = written(classes.join(wanted, "set_id", "left_semi").select("set_id", "one.*"), "wanted")
    n_sets = one.count()
    if n_sets <= SENT:
        one = F.broadcast(one)
    elif n_sets <= HASHED * partitions(rows.sparkSession):
        one = one.hint("shuffle_hash")  # else texts are sorted
    same = rows["doc_id"].eqNullSafe(one["doc_id"]) & (rows["text_hash"] == one["text_hash"])
    found = written(rows.select("doc_id", "text_hash", "text").join(one, same).select("set_id", "text"), "members")
    return found if found.count() == n_sets else written(found.dropDuplicates(["set_id"]), "members")  # repeated rows


def _apart(x: str, y: str, words: list[str] = BITMAP) -> str:
    """The suffix bound: by the sizes of their parts, so many members are in only one of two sets."""
    differ = " + ".join(f"bit_count({b}{x} ^ {b}{y})" for b in words)
    return f"{differ} <= n{x} + n{y} - 2 * ceil({NUM} * (n{x} + n{y}) / {NUM + DEN})"


def _bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the suffix bound leaves."""
    for k, c in ((1, "a"), (2, "b")):
        pairs = pairs.join(classes.select(F.col("set_id").alias(c), F.col("size").alias(f"n_{k}"), *(F.col(b).alias(f"{b}_{k}") for b in BITMAP)), c)
    return pairs.where(_apart("_1", "_2")).select("a", "b")


@dataclass
class Joined:
    """What the join is made of: documents, their classes (different sets), groups of classes."""

    of: DataFrame  # doc_id, text_hash, set_id, size, by document
    classes: DataFrame  # set_id, size, least (doc_id), copies
    groups: DataFrame  # node (a set), component
    members: DataFrame  # set_id, text of the sets that may have links
    n: int

    def alike(self, kind: str) -> DataFrame:
        """Similar sets inside the groups: x, y as in set_blocks.compared."""
        own = self.groups.select(F.col("component").alias("group"), F.col("node").alias("set_id"))
        sets = own.join(self.classes, "set_id").select("group", F.col("set_id").alias("e"), F.col("size").alias("n"), F.col("copies").alias("tag"))
        texts = _only(self.members, own.select("set_id"))
        return compared(sets, _contents(texts, self.n), kind)


def join_sets(docs: DataFrame, n: int = 5) -> Joined:
    """Classes of equal sets of docs, and the groups that links make of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    counts, n_shingles = _cell_counts(rows, n, _cells(rows))
    buckets = max(partitions(spark), -(-n_shingles // BUCKET))
    rank = spark.sparkContext.broadcast(counts)  # a byte a cell
    for seed in itertools.count(step=2):
        of = written(_set_table(rows, n, seed), "sets")
        one = F.min(F.struct("doc_id", "text_hash")).alias("one")
        bits = [F.max(b).alias(b) for b in BITMAP]
        sums = of.where("size > 0").groupBy("set_id").agg(
            F.max("size").alias("size"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), one, (F.min("again") < F.max("again")).alias("mixed"), *bits
        )
        classes = written(sums, "classes")
        if classes.where("mixed").isEmpty():  # else different sets share an id: other ids
            break
    pair_buckets = partitions(spark)
    met = written(_prefixes(rows, n, seed, rank, buckets).groupBy("bucket").applyInArrow(_met(rank, pair_buckets), PACKED), "met")
    first = met.where("kind = 0").groupBy("bucket").applyInArrow(_different, "a long, b long")
    first = written(_bounded(first, classes), "first")
    shared = _rows(met.where("kind = 1"), [("h", np.uint64, "long"), ("e", np.int64, "long"), ("n", np.int32, "int"), ("p", np.int32, "int")])
    ends = first.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(shared.select(F.col("e").alias("set_id")))
    members = _members(rows, classes, ends.distinct())
    links = written(_verified(first, members, n), "links")
    groups = written(components(links), "groups")

    placed = shared.join(groups.withColumnRenamed("node", "e"), "e", "left").withColumn("g", F.coalesce("component", "e")).drop("component")
    placed = written(placed, "placed")
    apart = placed.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("h", "m")
    placed = written(with_hot_key(placed, apart, "h"), "apart")
    more = _pairwise(placed.where(F.col("m") <= PAIRWISE), first, classes, members, n)
    many = placed.where(F.col("m") > PAIRWISE)
    if n_rows := many.count():
        lots = -(-n_rows // TOGETHER)
        dense = many.select(F.pmod("h", F.lit(lots)).alias("group"), "e", "n", F.col("g").alias("tag")).distinct()
        texts = _only(members, dense.select(F.col("e").alias("set_id")))
        found = compared(written(dense, "dense"), _contents(texts, n), "forest")
        more = more.unionByName(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    more = written(more, "more")
    if not more.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = written(components(stars.unionByName(more)), "groups")
    return Joined(of, classes, groups, members, n)


def _pairwise(placed: DataFrame, first: DataFrame, classes: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """The links between sets of different groups in shingles that at most PAIRWISE sets share."""
    some = BITMAP[:4]  # of each record; the pairs left are held to all
    placed = placed.join(classes.select(F.col("set_id").alias("e"), *some), "e")
    x, y = (placed.select("h", *(F.col(c).alias(f"{c}_{k}") for c in [*"enpg", *some])) for k in (1, 2))
    need = f"ceil({NUM} * (n_1 + n_2) / {NUM + DEN})"
    ahead = "(n_1 < n_2 or (n_1 = n_2 and e_1 < e_2))"
    near = f"{DEN} * n_1 >= {NUM} * n_2 and (p_1 <= n_1 div 7 or (n_1 = n_2 and p_2 <= n_2 div 7))"
    bound = f"least(p_1, p_2) + 1 + least(n_1 - 1 - p_1, n_2 - 1 - p_2) >= {need}"
    second = x.join(y, ["h"]).where(f"g_1 <> g_2 and {ahead} and {near} and {bound} and {_apart('_1', '_2', some)}")
    second = second.select(F.least("e_1", "e_2").alias("a"), F.greatest("e_1", "e_2").alias("b")).distinct()
    second = _bounded(second.join(first, ["a", "b"], "left_anti"), classes)
    return _verified(written(second, "second"), members, n)


def similar_groups(docs: DataFrame, n: int = 5, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, links for every row of docs; without count_links, no links.

    Texts are lower-cased (A-Z); a document's set holds its distinct shingles of n
    words, or its whole word sequence if that is shorter.  Two documents are
    linked if their sets' Jaccard similarity is at least 3/4; component_id is
    the smallest doc_id that links reach, its own included; links is the number of
    other documents that a document is linked with.  Null and empty
    texts, or texts without words, have empty sets and no links: they are their
    own component.  A null id is never the smallest unless a component has
    nothing else.  Repeated rows and copies are linked, having equal sets.
    Texts of any length are taken whole; further columns are not looked at.
    An empty table gives an empty table.
    """
    joined = join_sets(docs, n)
    sets = joined.classes.join(joined.groups.withColumnRenamed("node", "set_id"), "set_id", "left").where("copies > 1 or component is not null")
    sets = written(sets.select("set_id", "copies", "least", F.coalesce("component", "set_id").alias("component")), "linked")
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    named, links = with_hot_key(sets.drop("least"), least, "component"), []
    if count_links:  # their count takes every pair of a group, the group itself few
        between = joined.alike("links").groupBy(F.col("x").alias("set_id")).agg(F.sum("y").alias("others"))
        named = named.join(between, "set_id", "left").withColumn("links", F.col("copies") - 1 + F.coalesce("others", F.lit(0)))
        links = [F.coalesce("links", F.lit(0)).alias("links")]
    out = with_hot_key(joined.of.select("doc_id", "text_hash", "set_id", "size"), named.drop("component", "copies", "others"), "set_id", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *links)


def similar_pairs(docs: DataFrame, n: int = 5) -> DataFrame:
    """a, b: every pair of linked documents with different sets, each set by its smallest doc_id.

    As similar_groups; documents with equal sets are linked as well, and not listed.
    """
    joined = join_sets(docs, n)
    name = joined.classes.select("set_id", "least")
    pairs = joined.alike("pairs")
    for c, out in (("x", "u"), ("y", "v")):
        pairs = pairs.join(name.select(F.col("set_id").alias(c), F.col("least").alias(out)), c)
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
