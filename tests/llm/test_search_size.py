"""What a neighbour search holds and deals where no cell can be ruled out."""

import numpy as np
from flowlens.llm import neighbours
from flowlens.llm.common import written


def test_cells_are_asked_in_rounds_and_lots(spark, monkeypatch):
    rng, seen = np.random.default_rng(3), []
    v = rng.standard_normal((4_000, 16))
    table = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")

    def record(df, name):
        out = written(df, name)
        seen.append((name, out.columns, out.count()))
        return out

    monkeypatch.setattr(neighbours, "written", record)
    for name, value in {"CELL": 100, "NEAR": 4, "LOT": 500, "SENT": 20}.items():
        monkeypatch.setattr(neighbours, name, value)
    got = {}
    for r in neighbours.nearest(table, lambda i: i % 40 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    away = [(columns, n) for name, columns, n in seen if name == "away"]
    # 63 other cells in rounds of 4, 16 and the rest, each without vectors; all of a round's lots lead to one list of the k nearest.
    assert len(away) == 3 and all("q_vector" not in columns for columns, _ in away) and sum(n for _, n in away) > 2_000
    assert [n for name, _, n in seen if name == "found"] == [1_000] * sum([1, *(-(-n // 500) for _, n in away)])
    hit = 0
    for q, near in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert len(near) == 10 and np.allclose(list(near.values()), d[list(near)], rtol=0, atol=1e-12)
        d[q] = np.inf
        hit += len(set(near) & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 100 and hit >= 0.95 * 1_000
