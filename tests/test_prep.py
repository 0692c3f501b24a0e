"""Samples, caps and splits by hash histograms against sorted strata."""

import collections
import random

import pytest
from flowlens.ml import prep


def _first(rows, quota, seed=42):
    strata = collections.defaultdict(list)
    for key, *stratum in rows:
        strata[tuple(stratum)].append((((key % 2**31) * 2654435761 + seed) % 2**32, key))
    return sorted(key for own in strata.values() for _, key in sorted(own)[: quota(len(own))])


def _half_up(x):
    return int(x + 0.5)


@pytest.fixture(scope="module")
def table():
    """One stratum holds most rows; small ones, NULL ones, keys beyond 32 bits and keys whose hashes are equal."""
    r = random.Random(3)
    keys = [*range(3000), *(2**31 + k for k in range(0, 3000, 7)), *(10**12 + 13 * k for k in range(200))]
    return [(k, r.choice(["f", "f", "f", "g", None]), r.choice(["benign"] * 8 + ["attack", None])) for k in keys]


@pytest.mark.parametrize("boundary, bits, strata", [(500_000, 12, 20_000), (40, 4, 20_000), (1, 12, 2), (0, 5, 0)])
def test_first_rows(spark, monkeypatch, table, boundary, bits, strata):
    for name, n in (("BOUNDARY", boundary), ("BITS", bits), ("STRATA", strata)):
        monkeypatch.setattr(prep, name, n)
    df = spark.createDataFrame(table, "id long, file string, label string")
    keys = lambda df: sorted(r.id for r in df.collect())
    assert keys(prep.stratified(df, ["file", "label"], "id")) == _first(table, lambda n: _half_up(n * 0.15))
    assert keys(prep.capped(df, "file", "id", 150)) == _first([(k, f) for k, f, _ in table], lambda n: 150)
    parts = prep.split(df, "id")
    assert parts.columns == ["id", "file", "label", "validation"] and parts.count() == len(table)
    assert keys(parts.where("validation = 1")) == _first([(k, y) for k, _, y in table], lambda n: _half_up(n * 0.2))


def test_edges(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (2, "b")], "id long, label string")
    assert sorted((r.id, r.validation) for r in prep.split(df, "id", share=1.0).where("id is not null").collect()) == [(1, 1), (2, 1)]
    assert prep.split(df, "id", share=1.0).where("id is null").first().validation == 0
    assert prep.split(df, "id", share=0.2).where("validation = 1").count() == 0  # no row of a stratum of one
    assert prep.split(df.where("id > 9"), "id").count() == 0 and prep.capped(df, "label", "id", 5).count() == 2
    assert prep.stratified(df, ["label"], "id", 1.0).count() == 3
