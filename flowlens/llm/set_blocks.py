"""Exact comparison of all similar-sized sets of a group, in units of bounded size.

A group of few members is one unit.  A larger one is cut by size into bands, so that
similar sets lie in one band or in neighbouring ones, and bands into parts; a
unit compares two parts, or a part with itself.  The members' contents go to the
units they are in, units are dealt to tasks, and pairs live inside a task only:
what leaves it are counts by set, or the links that a forest needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import partitions, with_hot_key, written
from flowlens.llm.packed import heads

#: Elements of a unit's side at most, about; every set counts as SET_COST more.
UNIT, SET_COST = 250_000, 250
#: Elements that are sent to units at once, about; what more units need goes in further rounds.
ROUND = 250_000_000
#: Sizes of a band differ by less than this: more than the largest ratio of similar sets (4/3).
BAND = 1.34
#: Elements that are compared at once.
COLUMNS = 1024
_PLACE = ["group", "b", "i", "c", "j"]


def required(a, b):
    """Least overlap of sets of sizes a and b with a Jaccard similarity of 3/4."""
    return -(-3 * (a + b) // 7)


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every set of x with every one of y; sets are arrays without repeats."""
    hx, hy = np.concatenate(x), np.concatenate(y)
    common = np.intersect1d(hx, hy)
    out = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for sets, h in ((x, hx), (y, hy)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
        hit = common[at] == h if len(common) else np.zeros(len(h), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((owner[hit][order], at[hit][order]))
    for a in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - a)
        part = []
        for sets, (owner, at) in zip((x, y), sides, strict=True):
            low, high = np.searchsorted(at, [a, a + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[low:high], at[low:high] - a] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out  # whole numbers below 2^24


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b), as few as connect the same nodes."""
    parent: dict[int, int] = {}

    def root(v):
        while (p := parent.get(v, v)) != v:
            parent[v] = v = parent.get(p, p)
        return v

    out = []
    for x, y in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).T.tolist():
        if (u := root(x)) != (v := root(y)):
            parent[u] = v
            out.append((x, y))
    return out


def _units(table: pa.Table) -> Iterator[tuple[tuple, tuple]]:
    """The two sides of every unit of a table: (ids, tags, sets); one side twice where a part meets itself."""
    cols = {c: table.column(c).to_numpy() for c in [*_PLACE, "side", "e", "tag"]}
    data = table.column("data").to_pylist()
    order = np.lexsort((cols["side"], *(cols[c] for c in reversed(_PLACE))))
    new = np.zeros(len(order), bool)
    for c in _PLACE:
        new |= heads(cols[c][order])
    for rows in np.split(order, np.flatnonzero(new)[1:]) if len(order) else ():
        sides = []
        for k in (0, 1):
            mine = rows[cols["side"][rows] == k]
            sides.append((cols["e"][mine], cols["tag"][mine], [np.frombuffer(data[r], np.uint64) for r in mine.tolist()]))
        if len(sides[1][0]):
            yield sides[0], sides[1]
        else:
            yield sides[0], sides[0]


def _compare(kind: str):
    def compare(table: pa.Table) -> pa.Table:
        xs, ys = [], []
        for (e, tag, x), (f, other, y) in _units(table):
            if not len(e) or (x is y and len(e) < 2):
                continue
            n, m = np.array([len(s) for s in x]), np.array([len(s) for s in y])
            alike = overlaps(x, y) >= required(n[:, None], m[None, :]).astype(np.float32)
            if x is y:
                np.fill_diagonal(alike, False)
            if kind == "links":  # the tag is the number of copies
                for ids, links in ((e, alike @ other), (f, alike.T @ tag)):
                    xs.append(ids)
                    ys.append(links)
                    if x is y:
                        break
                continue
            if kind == "forest":  # the tag is what the set already belongs to
                alike &= tag[:, None] != other[None, :]
                at, to = np.nonzero(alike)
                found = np.array(_forest(tag[at], other[to]), np.int64).reshape(-1, 2)
                xs.append(found[:, 0])
                ys.append(found[:, 1])
                continue
            at, to = np.nonzero(np.triu(alike) if x is y else alike)
            xs.append(np.minimum(e[at], f[to]))
            ys.append(np.maximum(e[at], f[to]))
        both = [np.concatenate([np.empty(0, np.int64), *v]).astype(np.int64) for v in (xs, ys)]
        return pa.table({"x": both[0], "y": both[1]})

    return compare


def _placed(members: DataFrame) -> DataFrame:
    """members with the units they are in: b, i, c, j (bands and parts of both sides) and side."""
    cost = F.col("n").cast("long") + SET_COST
    totals = members.groupBy("group").agg(F.sum(cost).alias("_all"))
    sized = with_hot_key(members, totals, "group")
    small = sized.where(F.col("_all") <= UNIT).select(*members.columns, *[F.lit(0).alias(c) for c in (*_PLACE[1:], "side")])
    banded = sized.where(F.col("_all") > UNIT).withColumn("band", F.floor(F.log("n") / F.lit(math.log(BAND))).cast("int"))
    parts = banded.groupBy("group", "band").agg(F.ceil(F.sum(cost) / UNIT).cast("int").alias("parts"))
    shifted = [parts.select("group", (F.col("band") + d).alias("band"), F.col("parts").alias(name)) for d, name in ((1, "below"), (-1, "above"))]
    near = parts
    for other in shifted:
        near = near.join(other, ["group", "band"], "left")
    near = near.na.fill(0).withColumn("_band", F.xxhash64("group", "band"))
    banded = banded.withColumn("_band", F.xxhash64("group", "band")).drop("group", "band")
    dealt = with_hot_key(banded, near, "_band").withColumn("part", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int"))
    place = "named_struct('b', cast({} as int), 'i', cast({} as int), 'c', cast({} as int), 'j', cast({} as int), 'side', {})"
    own = f"array({place.format('band', 'part', 'band', 'part', 0)})"
    each = lambda n, where, what: f"transform(filter(sequence(0, greatest({n}, 1) - 1), q -> {where}), q -> {what})"
    units = ", ".join(
        [
            own,
            each("parts", "q > part", place.format("band", "part", "band", "q", 0)),
            each("parts", "q < part", place.format("band", "q", "band", "part", 1)),
            each("above", "q < above", place.format("band", "part", "band + 1", "q", 0)),
            each("below", "q < below", place.format("band - 1", "q", "band", "part", 1)),
        ]
    )
    big = dealt.select(*members.columns, F.explode(F.expr(f"concat({units})")).alias("_u")).select(*members.columns, "_u.*")
    return small.unionByName(big)


def compared(members: DataFrame, contents: DataFrame, kind: str) -> DataFrame:
    """x, y by the pairs of similar sets inside the groups of members.

    members: group, e (a set), n (its size), tag; contents: e, data (its elements,
    unsigned 64-bit).  kind "links": a set and the sum of the tags of the sets it is
    similar to, in parts to be summed.  "forest": tags connected by similar
    sets, as few pairs as connect them within a unit.  "pairs": every pair of similar sets.
    """
    placed = written(_placed(members), "units")
    total = placed.agg(F.sum(F.col("n").cast("long") + SET_COST)).first()[0] or 0
    tasks = max(partitions(members.sparkSession), -(-total // (4 * UNIT)))
    dealt = placed.withColumn("unit", F.pmod(F.xxhash64(*_PLACE), F.lit(tasks)))
    find = lambda some: some.join(contents, "e").groupBy("unit").applyInArrow(_compare(kind), "x long, y long")
    if (rounds := -(-total // ROUND)) <= 1:
        return find(dealt)
    # Contents go to as many units as their group has parts: a share of the units at a time, so that disks hold only its contents.
    found = [find(dealt.where(F.pmod("unit", F.lit(rounds)) == k)) for k in range(rounds)]
    if kind == "links":
        found = [f.groupBy("x").agg(F.sum("y").alias("y")) for f in found]
    return reduce(DataFrame.unionByName, [written(f, "found") for f in found])
