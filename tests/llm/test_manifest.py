"""Merkle manifests against a tree built by hand, and edge cases."""

import hashlib
import random

import pytest

from flowlens.llm import catalog, manifest
from pyspark.sql import functions as F

from oracle import expected, rows

SMALL = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout=3):
    """Root, and per leaf the steps (before, after)."""
    steps, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for leaf, k in enumerate(at):
            first = k // fanout * fanout
            steps[leaf].append(("".join(level[first:k]), "".join(level[k + 1 : first + fanout])))
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
        at = [k // fanout for k in at]
    return level[0], steps


def tree(leaves, fanout=3):
    """{(group, order, digest): (subroot, root, proof)} of (group, order, digest)."""
    groups = sorted({g for g, *_ in leaves}, key=lambda g: (g is not None, (g or "").encode()))
    own, subs = {}, []
    for g in groups:
        members = sorted((r for r in leaves if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        sub, steps = climb([r[2] for r in members], fanout)
        subs.append(sub)
        own |= {(r, k): (sub, s) for k, (r, s) in enumerate(zip(members, steps, strict=True))}
    root, upper = climb(subs, fanout)
    above = dict(zip(groups, upper, strict=True))
    return sorted(repr((r, sub, root, s + above[r[0]])) for (r, _), (sub, s) in own.items())


def got(df):
    return sorted(repr(((r.source, r.doc_id, r.leaf), r.subroot, r.root, [tuple(s) for s in r.proof])) for r in df.select("source", "doc_id", "leaf", "subroot", "root", "proof").collect())


@pytest.mark.parametrize(("sizes", "fanout"), [({"a": 29, "b": 1, None: 10, "ä": 3, "z\U0001f600": 4, "Z": 2, "-": 9, "": 27}, 3), ({"one": 1}, 3), ({None: 7}, 2), ({"x": 3, "y": 1, "w": 1, "v": 1, "u": 1}, 4)])
def test_trees(spark, sizes, fanout):
    rng = random.Random(1)
    leaves = [(g, rng.choice([None, *range(10**6)]) if k else None, H(str(g), str(k))) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in leaves], "source string, doc_id long, leaf string, root string, _key string")
    made = manifest.merkle_manifest(df, fanout=fanout)
    assert made.columns == ["source", "doc_id", "leaf", "_key", "subroot", "root", "proof"]
    assert got(made) == tree(leaves, fanout)
    assert made.where(manifest.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert made.where(manifest.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0


def test_repeated_rows_and_empty_tables(spark):
    leaves = [("s", 1, H("a"))] * 5 + [("s", 2, H("b")), (None, None, H("c"))]
    df = spark.createDataFrame(leaves, "source string, doc_id long, leaf string")
    assert got(manifest.merkle_manifest(df)) == tree(leaves)
    assert manifest.merkle_manifest(df.limit(0)).collect() == []
    one = manifest.merkle_manifest(df.limit(1)).first()
    assert one.root == one.subroot == one.leaf and one.proof == []


def test_leaf_digests(spark):
    long = "ü\n" * 500_000
    df = spark.createDataFrame([(7, None, "é", long), (None, "", None, None)], "doc_id long, source string, lang string, text string")
    one, two = df.select(manifest.leaf_digest(*[F.col(c) for c in df.columns]).alias("h"), manifest.tampered(F.col("text"), F.lit(0)).alias("t")).collect()
    assert one.h == H("1:7", "-", "2:é", f"1500000:{long}") and two.h == H("-", "0:", "-", "-")
    assert one.t in (long, "ü" * 500_000) and two.t is None


def test_query(spark):
    df = catalog.QUERIES["op12_manifest"](spark, SMALL)
    made = df.collect()
    assert rows(made) == expected(catalog.ORACLE_SQL["op12_manifest"], SMALL, df.columns)
    assert {r.verified for r in made} == {True, False} and len({r.root for r in made}) == 1
