"""Neighbour search in several cells, with repeated rows, clashing columns and extreme numbers."""

import numpy as np
import pytest
from flowlens.llm import neighbours
from pyspark.sql import functions as F


def _nearest(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "cell", "rank", "score", "bound", "part", "times"):
        table = table.withColumn(c, F.lit("mine"))
    return [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(table, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()]


def test_repeated_rows_leave_other_ids_in(spark):
    got = _nearest(spark, [(100, [1.0, 0.0])] * 12 + [(200, [1.0, 0.0]), (301, [2.0, 0.0])])
    assert got[:2] == [(100, 1, 200, 0.0), (100, 2, 301, 1.0)]
    assert got[2:] == [(200, r, 100, 0.0) for r in range(1, 11)]


def test_extreme_numbers_have_distances(spark):
    got = _nearest(spark, [(100, [1e200, 0.0]), (1, [2e200, 0.0]), (2, [1e200, 3e199]), (3, [1e-200, 1.0])])
    assert [(v, pytest.approx(d)) for _, _, v, d in got] == [(2, 3e199), (1, 1e200), (3, 1e200)]
    got = _nearest(spark, [(100, [1e-200, 0.0]), (1, [3e-200, 0.0])])
    assert got == [(100, 1, 1, pytest.approx(2e-200))]


@pytest.mark.parametrize("kind", ["clustered", "gaussian"])
def test_recall_in_several_cells(spark, kind):
    rng = np.random.default_rng(12)
    n, width = 20_000, 16
    v = rng.standard_normal((n, width))
    if kind == "clustered":
        v = 0.2 * v + 5 * rng.standard_normal((60, width))[rng.integers(0, 60, n)]
    got = {}
    for q, _, i, d in _nearest(spark, [(k, x) for k, x in enumerate(v.tolist())]):
        got.setdefault(q, []).append((i, d))
    hit = 0
    for q in range(0, n, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert len(got[q]) == 10 and np.allclose([x for _, x in got[q]], d[[i for i, _ in got[q]]], rtol=0, atol=1e-12)
        d[q] = np.inf
        hit += len({i for i, _ in got[q]} & set(np.argsort(d)[:10].tolist()))
    print(kind, "recall", hit / (n / 10))
    assert hit >= 0.9 * n / 10
