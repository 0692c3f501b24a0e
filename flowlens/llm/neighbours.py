"""Approximate nearest neighbours: stable low-dimensional projections in a kd-tree.

Vectors are projected by Gaussian (2-stable) directions.  For two vectors at
distance d the squared projected distance is d * d times a chi-square variable, so
projected neighbours, taken nearest first and verified on the original vectors,
may stop once a vector nearer than the kth best would lie farther out only with
small probability: chi-square test of (next projected distance / kth distance)
squared.

The upper levels of the kd-tree are cells of the projected space that Spark
partitions by; their splits are fitted on a bounded sample, every row is indexed.
The lower levels are built within a cell.  A query searches its own cell first;
the kth distance found there bounds, by the same test, which other cells can
hold a nearer vector, and only those are searched then, in rounds of the nearest cells left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import written

#: Projected dimensions.
DIMENSIONS = 8
#: Rows that the cell splits are fitted on, at most about.
SAMPLE = 20_000
#: Vectors of a cell, about, and of a leaf of the tree within.
CELL, LEAF = 4096, 32
#: Queries of a cell that are searched together.
QUERIES = 2048
#: Further cells that a query looks at first, four times as many then; searches of a cell by a query that are dealt together, about; rows of a batch of them.
NEAR, LOT, SENT = 256, 1_000_000, 50_000
#: A vector nearer than the kth is missed by a test with this probability at most.
MISS = 0.02


def chi_square_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Distribution function for an even number m of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 200.0 + 10 * m
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array([mid]), m)[0] < p else (low, mid)
    return high


def directions(width: int, m: int = DIMENSIONS, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, m))


class Cells:
    """Upper kd-tree: median splits of a sample, halved until a part is small enough."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, m = depth, points.shape[1]
        self.dim = np.zeros(2**depth - 1, np.int64)
        self.at = np.zeros(2**depth - 1)
        self.low = np.full((2**depth, m), -np.inf)
        self.high = np.full((2**depth, m), np.inf)
        parts = {0: points}
        boxes = {0: (np.full(m, -np.inf), np.full(m, np.inf))}
        for node in range(2**depth - 1):
            p = parts.pop(node)
            low, high = boxes.pop(node)
            d = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            cut = float(np.median(p[:, d])) if len(p) else 0.0
            self.dim[node], self.at[node] = d, cut
            right = p[:, d] > cut
            for child, rows, side in ((2 * node + 1, p[~right], 0), (2 * node + 2, p[right], 1)):
                a, b = low.copy(), high.copy()
                (b if side == 0 else a)[d] = cut
                parts[child], boxes[child] = rows, (a, b)
        for leaf in range(2**depth):
            self.low[leaf], self.high[leaf] = boxes[2**depth - 1 + leaf]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.dim[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to every cell."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree within a cell."""
    out, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        p = points[rows]
        d = int(np.argmax(np.ptp(p, axis=0)))
        half = len(rows) // 2
        order = np.argpartition(p[:, d], half)
        stack += [rows[order[:half]], rows[order[half:]]]
    return out


def _merge(dist, ids, more_dist, more_ids, k):
    """The k least (distance, id) of two lists, by row."""
    d, i = np.concatenate([dist, more_dist], 1), np.concatenate([ids, more_ids], 1)
    order = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def _lengths(diff: np.ndarray) -> np.ndarray:
    """Euclidean lengths along the last axis; what would overflow or vanish when squared is scaled first."""
    square = np.einsum("...d,...d->...", diff, diff)
    odd = ~np.isfinite(square) | (square < 1e-290)
    out = np.sqrt(square)
    if odd.any():
        x = diff[odd]
        most = np.abs(x).max(-1, keepdims=True)
        most[most == 0] = 1
        out[odd] = most[:, 0] * np.sqrt(((x / most) ** 2).sum(-1))
    return out


def search_cell(vectors, ids, points, q_vectors, q_ids, q_points, bound, k, miss):
    """(distance, id) of each query's k nearest found in one cell, inf and -1 where fewer."""
    m, n_q = points.shape[1], len(q_ids)
    limit = chi_square_quantile(1 - miss, m)
    leaves = _leaves(points)
    low = np.stack([points[r].min(0) for r in leaves])
    high = np.stack([points[r].max(0) for r in leaves])
    size = max(len(r) for r in leaves)
    padded = np.stack([np.pad(r, (0, size - len(r)), constant_values=-1) for r in leaves])
    dist, found = np.full((n_q, k), np.inf), np.full((n_q, k), np.iinfo(np.int64).max)
    for a in range(0, n_q, 256):
        b = min(a + 256, n_q)
        gap = np.maximum(np.maximum(low[None] - q_points[a:b, None], q_points[a:b, None] - high[None]), 0)
        away = (gap * gap).sum(2)
        order = np.argsort(away, axis=1)
        active = np.arange(b - a)
        for step in range(len(leaves)):
            # The stopping test: nothing nearer than the kth is likely to be this far out.
            kth = np.minimum(dist[a + active, k - 1], bound[a + active])
            leaf = order[active, step]
            active_now = away[active, leaf] <= limit * kth * kth
            active, leaf = active[active_now], leaf[active_now]
            if not len(active):
                break
            rows = padded[leaf]
            d = _lengths(vectors[rows] - q_vectors[a + active, None])
            got = ids[rows]
            skip = (rows < 0) | (got == q_ids[a + active, None])
            d = np.where(skip, np.inf, d)
            got = np.where(skip, np.iinfo(np.int64).max, got)
            dist[a + active], found[a + active] = _merge(dist[a + active], found[a + active], d, got, k)
    return dist, found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (doubles): vectors that are not null, empty or zero, nor hold null or non-finite numbers."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), v.alias("vector")
    )


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = MISS, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds.

    score is the Euclidean distance of the original vectors in double precision;
    ties go to smaller ids; a row is never its own neighbour.  Vectors null,
    empty, zero or with null or non-finite components take no part, nor do null
    ids or vectors of another length than most rows have.  Fewer than k other
    rows give all of them.  Repeated rows of an id count as often as they come,
    but not for their own id; a query whose rows differ is asked by its least vector.  Of equal vectors only the k + 1 smallest ids can be among
    the k nearest of any query, so a vector that a third of all rows share is
    searched by these; no other row is left out of the index.
    An empty table gives an empty table; further columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    width, n_rows = lengths[0]["n"], lengths[0]["count"]
    rows = rows.where(F.size("vector") == width)
    axes = directions(width, seed=seed)
    depth = max(0, math.ceil(math.log2(max(n_rows / CELL, 1))))
    part = min(1.0, SAMPLE / n_rows)
    drawn = rows.where(F.xxhash64(F.lit(seed), "id").bitwiseAND(F.lit(2**30 - 1)) < int(part * 2**30)).select("vector").toArrow()
    sample = _matrix(drawn.column("vector"), width) @ axes
    while depth and 2**depth > max(len(sample) // 4, 1):
        depth -= 1
    cells = spark.sparkContext.broadcast(Cells(sample, depth))  # two numbers a cell

    def placed(batches):
        for batch in batches:
            v = _matrix(batch.column("vector"), width)
            cell = cells.value.of(v @ axes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cell, pa.int64())], ["id", "vector", "cell"])

    index = written(rows.mapInArrow(placed, "id long, vector array<double>, cell long"), "index")
    queries = index.where(is_query(F.col("id"))).groupBy(F.col("id").alias("q_id")).agg(F.min(F.struct("vector", "cell")).alias("q"))
    queries = written(queries.select("q_id", F.col("q.vector").alias("q_vector"), "q.cell"), "queries")

    # Of equal vectors, the smallest ids; summed per task first, as min_k is.
    kept = index.groupBy("cell", "vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    dealt = kept.withColumn("_same", F.xxhash64("vector")).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("cell", "_same", "vector", "_salt").orderBy("id")
    some = dealt.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    again = Window.partitionBy("cell", "_same", "vector").orderBy("id")
    some = some.withColumn("_n", F.row_number().over(again)).where(F.col("_n") <= k + 1)
    some = some.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    searched = written(some.select("id", "vector", "cell"), "searched")
    # Cells that are still large are dealt out in parts, each searched by all of the cell's queries.
    sizes = searched.groupBy("cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("parts"))
    dealt = searched.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    data = dealt.select("cell", "part", "id", "vector")

    def search(tables_key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = left.column("id").to_numpy(), _matrix(left.column("vector"), width) if left.num_rows else None
        q, b = right.column("q_id").to_numpy(), right.column("bound").to_numpy()
        if v is None or not len(q):
            return pa.table({"q_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        qv = _matrix(right.column("q_vector"), width)
        d, f = search_cell(v, ids, v @ axes, qv, q, qv @ axes, b, k, miss)
        ok = f < np.iinfo(np.int64).max
        return pa.table({"q_id": np.repeat(q, ok.sum(1)), "id": f[ok], "d": d[ok]})

    def run(asked: DataFrame) -> DataFrame:
        """asked: q_id, q_vector, bound, cell, in blocks of queries."""
        wide = asked.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        groups = F.ceil(F.count("*") / QUERIES).cast("int")
        blocks = wide.groupBy("cell", "part").agg(groups.alias("blocks"))
        asked = wide.join(blocks, ["cell", "part"]).withColumn("block", F.pmod(F.xxhash64("q_id"), F.col("blocks")).cast("int"))
        against = data.join(blocks, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = against.select("cell", "part", "block", "id", "vector").groupBy("cell", "part", "block")
        right = asked.select("cell", "part", "block", "q_id", "q_vector", "bound").groupBy("cell", "part", "block")
        return left.cogroup(right).applyInArrow(search, "q_id long, id long, d double")

    by = Window.partitionBy("q_id").orderBy("d", "id")

    def top(found: DataFrame) -> DataFrame:
        return written(found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).drop("n"), "found")

    limit = chi_square_quantile(1 - miss, DIMENSIONS)

    def others(least: int, most: int):
        """A row for every other cell that the test does not rule out, of the cells from the least to the most but one in order of nearness."""
        sent = max(1, SENT // (most - least))  # queries to a batch, whatever the number of cells

        def choose(batches):
            for batch in batches:
                v = _matrix(batch.column("q_vector"), width) @ axes
                home_cell, bound = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
                for first in range(0, len(v), sent):
                    rows_, cells_ = [], []
                    for i in range(first, min(first + sent, len(v))):
                        gaps = cells.value.distances(v[i])
                        order = np.argsort(gaps, kind="stable")
                        order = order[order != home_cell[i]][least:most]
                        near = order[gaps[order] <= limit * bound[i] ** 2]
                        rows_.append(np.full(len(near), i))
                        cells_.append(near)
                    taken = pa.array(np.concatenate(rows_))
                    yield pa.RecordBatch.from_arrays([batch.column("q_id").take(taken), batch.column("bound").take(taken), pa.array(np.concatenate(cells_), pa.int64())], ["q_id", "bound", "cell"])

        return choose

    # The home cell's bound holds for all others.  They are asked in rounds, nearest first; vectors go to a lot of queries and cells at a time.
    best, at, span = top(run(queries.withColumn("bound", F.lit(float("inf"))))), 0, NEAR
    kth = best.groupBy("q_id").agg(F.max("d").alias("kth"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("inf"))).alias("bound")
    bounded = queries.join(kth, "q_id", "left").select("q_id", "q_vector", "cell", bound)
    while at < 2**depth - 1:
        away = written(bounded.mapInArrow(others(at, at + span), "q_id long, bound double, cell long"), "away")
        if not (asked := away.count()):
            break  # farther cells are ruled out as well
        lots = -(-asked // LOT)
        for lot in range(lots):
            some = away.where(F.pmod("cell", F.lit(lots)) == lot).join(queries.drop("cell"), "q_id")
            best = top(best.unionByName(run(some)))
        at, span = at + span, 4 * span
    ranked = best.withColumn("rank", F.row_number().over(by))
    return ranked.select(F.col("q_id").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), F.col("d").alias("score"))
