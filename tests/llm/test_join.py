"""The n-gram join's links and pairs, and the block comparison behind them, against brute force."""

import itertools
import random

import numpy as np
import pytest
from flowlens.llm import ngram_join, set_blocks
from flowlens.llm.ngram_join import CELLS, HOT

from test_operators import SCHEMA, _brute_groups, _corpus, _words


def _shingles(text, n=5):
    words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in _words(text)]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def _links(rows):
    sets = [_shingles(r[1]) for r in rows]
    return [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], sets


def _near_copies(n=60, seed=4):
    rng = random.Random(seed)
    base = [f"u{k}" for k in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(120)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words[: rng.choice([90, 110, 120])]), "en", "s", 0))
    return rows


@pytest.mark.parametrize("rows", [_corpus(), _near_copies()], ids=["corpus", "near copies"])
def test_links_and_pairs_are_exact(spark, rows):
    links, sets = _links(rows)
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.links for r in ngram_join.similar_groups(table).collect()}
    assert got == {r[0]: sum(i in pair for pair in links) for i, r in enumerate(rows)}
    least = {}
    for r, s in sorted(zip(rows, sets), key=lambda x: -x[0][0]):
        least[frozenset(s)] = r[0]
    want = {tuple(sorted((least[frozenset(sets[a])], least[frozenset(sets[b])]))) for a, b in links if sets[a] != sets[b]}
    pairs = [(r.a, r.b) for r in ngram_join.similar_pairs(table).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_blocks_alone_find_all_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRWISE", 0)
    monkeypatch.setattr(ngram_join, "TOGETHER", 50)
    monkeypatch.setattr(set_blocks, "UNIT", 5_000)
    monkeypatch.setattr(ngram_join, "FEW", 1)  # no pair is verified first
    monkeypatch.setattr(ngram_join, "ORDERS", 0)
    rows = _near_copies(40) + [(100 + r[0], r[1], *r[2:]) for r in _corpus(20)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute_groups([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("unit", [500_000, 3_000])
def test_blocks_find_every_pair(spark, monkeypatch, unit):
    monkeypatch.setattr(set_blocks, "UNIT", unit)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 400, dtype=np.uint64)
    sets = [np.unique(rng.permutation(base[: rng.integers(1, 400)])[rng.integers(0, 30) :]) for _ in range(150)]
    sets = [s if len(s) else base[:1] for s in sets]
    group = [k % 3 for k in range(len(sets))]
    want = {}
    for a, b in itertools.combinations(range(len(sets)), 2):
        if group[a] == group[b] and 4 * len(np.intersect1d(sets[a], sets[b])) >= 3 * len(np.union1d(sets[a], sets[b])):
            want[a, b] = True
    members = spark.createDataFrame([(g, k, len(s), k + 1) for k, (g, s) in enumerate(zip(group, sets))], "group long, e long, n int, tag long")
    contents = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "e long, data binary")
    pairs = [(r.x, r.y) for r in set_blocks.compared(members, contents, "pairs").collect()]
    assert sorted(pairs) == sorted(want) and want
    sums = {r.x: r["sum(y)"] for r in set_blocks.compared(members, contents, "links").groupBy("x").sum("y").collect()}
    for k in range(len(sets)):
        assert sums.get(k, 0) == sum(a + b - k + 1 for a, b in want if k in (a, b))
    forest = [(r.x - 1, r.y - 1) for r in set_blocks.compared(members, contents, "forest").collect()]
    assert set(map(frozenset, forest)) <= set(map(frozenset, want)) and _roots(forest, len(sets)) == _roots(want, len(sets))


def _roots(edges, n):
    root = list(range(n))
    for a, b in edges:
        a, b = root[a], root[b]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_hot_shingles_are_dealt_to_buckets_and_stay_open():
    rank = np.zeros(CELLS, np.int64)
    rank[77] = 5 * HOT
    e = np.arange(1, 4001)
    h = np.full(len(e), 77, np.uint64)
    buckets = ngram_join._buckets(h, e, rank, 64)
    assert 2 <= len(set(buckets.tolist())) <= 6
    assert len(set(ngram_join._buckets(np.full(9, 78, np.uint64), e[:9], rank, 64).tolist())) == 1
    one = ngram_join.pa.Table.from_batches([ngram_join.packed(0, [(0, [h[:1], e[:1], np.full(1, 9, np.int32), np.zeros(1, np.int32)])])])
    out = ngram_join._first_pairs(one, rank, 4)
    assert out.filter(ngram_join.pa.compute.equal(out["kind"], 1))["data"][0].as_py()[1] == e[:1].tobytes()
