"""What the n-gram join keeps as its input grows: cells of shingles, shuffle files, contents sent to units."""

import time

import numpy as np
from flowlens.llm import ngram_join, set_blocks
from flowlens.llm.common import CLEANED, written

from test_operators import SCHEMA, _brute_groups, _corpus


def test_cells_grow_with_the_texts(spark, monkeypatch):
    """A cell holds about as many shingles whatever the corpus, and every shingle is counted once."""
    for name, value in {"LETTERS": 40, "FEWEST_BITS": 3, "MOST_BITS": 12, "PART_BITS": 4, "COUNTED": 500}.items():
        monkeypatch.setattr(ngram_join, name, value)
    few, many = (spark.createDataFrame([(" ".join(f"w{i:02}x{k}" for k in range(50)),) for i in range(n)], "text string") for n in (8, 64))
    cells = [ngram_join._cells(t) for t in (few, many)]
    assert cells[1] == 8 * cells[0]
    for table, n in zip((few, many), cells, strict=True):
        rank, total = ngram_join._cell_counts(table, 5, n)
        want = np.zeros(n, np.int64)
        for _, words in ngram_join.blocks(table.toArrow().column("text"), ngram_join.LOWER):
            np.add.at(want, (ngram_join.shingles(words, 5)[0] & np.uint64(n - 1)).astype(np.int64), 1)
        assert rank.dtype == np.uint8 and len(rank) == n and total == want.sum() and want.mean() < 16
        assert (rank == ngram_join._coded(want)).all() and np.allclose(ngram_join._DECODED[rank], want, rtol=0.1, atol=1)
    rows = _corpus(30)
    got = ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA), count_links=False)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and {tuple(r) for r in got.collect()} == _brute_groups([(r[0], r[1]) for r in rows])


def test_rounds_of_units_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(set_blocks, "UNIT", 3_000)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 400, dtype=np.uint64)
    sets = [np.unique(base[rng.integers(0, 30) : rng.integers(200, 400)]) for _ in range(80)]
    members = spark.createDataFrame([(k % 2, k, len(s), k + 1) for k, s in enumerate(sets)], "group long, e long, n int, tag long")
    contents = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "e long, data binary")

    def links():
        return {r.x: r["sum(y)"] for r in set_blocks.compared(members, contents, "links").groupBy("x").sum("y").collect()}

    def pairs():
        return sorted(map(tuple, set_blocks.compared(members, contents, "pairs").collect()))

    want, names = (links(), pairs()), []
    monkeypatch.setattr(set_blocks, "written", lambda df, name: (names.append(name), written(df, name))[1])
    monkeypatch.setattr(set_blocks, "ROUND", 40_000)
    assert (links(), pairs()) == want and want[1] and names.count("found") >= 4


def test_shuffle_files_go_with_what_is_written(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, was = blocks.getAllFiles().size(), spark.conf.get(CLEANED)
    table = written(spark.range(20_000).selectExpr("id % 5000 as k").groupBy("k").count(), "counts")
    for _ in range(50):
        if (now := blocks.getAllFiles().size()) <= before:
            break
        time.sleep(0.1)
    assert now <= before and table.count() == 5000 and spark.conf.get(CLEANED) == was
