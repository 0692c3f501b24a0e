"""Nearest neighbours against brute force."""

import math
import random

import pytest
from flowlens.ml import models
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F


def _brute(train, queries, k):
    out = {}
    for i, q in queries:
        near = sorted((math.dist(q, v), j, label) for j, v, label in train)[:k]
        votes = {}
        for d, _, label in near:
            votes[label] = votes.get(label, 0) + (1e18 if d == 0 else 1 / d)
        out[i] = min(votes, key=lambda x: (-votes[x], x))
    return out


def test_knn_in_blocks(spark, monkeypatch):
    for name, n in (("BLOCK", 30), ("SLICE", 70), ("COLUMNS", 16), ("CELLS", 9)):
        monkeypatch.setattr(models, name, n)
    r = random.Random(1)
    at = lambda: [float(r.randint(0, 3)), r.gauss(0, 1) * r.randint(0, 1), float(r.randint(0, 2))]
    train = [(i, at(), r.choice("xyz")) for i in range(400)]
    queries = [(1000 + i, at()) for i in range(150)]
    t = spark.createDataFrame(train, "id long, vector array<double>, label string")
    q = spark.createDataFrame(queries, "id long, vector array<double>")
    got = {x["id"]: x["prediction"] for x in models.knn(t, q, 7).collect()}
    assert got == _brute(train, queries, 7)
    assert models.knn(t.where("id < 0"), q).count() == 0 and models.knn(t, q.where("id < 0")).count() == 0


def test_nearest_leaves_cells_out(spark, monkeypatch):
    monkeypatch.setattr(models, "CELLS", 64)
    monkeypatch.setattr(models, "SLICE", 300)
    r = random.Random(2)
    near = lambda c: [r.gauss(x, 1) for x in c]
    centres = [[r.uniform(-40, 40) for _ in range(6)] for _ in range(12)]
    train = [(i, near(centres[0 if i % 3 == 0 else i % 12]), "x") for i in range(3000)]  # a third around one centre
    queries = [(10_000 + i, near(centres[i % 12])) for i in range(120)]
    got = models.nearest(spark.createDataFrame(train, "id long, vector array<double>, label string"), spark.createDataFrame(queries, "id long, vector array<double>"), 10).collect()
    found, compared = {}, {}
    for x in sorted(got, key=lambda x: x.n):
        found.setdefault(x.id, []).append(x.neighbour)
        compared[x.id] = x.compared
    assert found == {i: [j for _, j in sorted((math.dist(q, v), j) for j, v, _ in train)[:10]] for i, q in queries}
    assert sum(compared.values()) < 0.5 * len(train) * len(queries)
    print(sum(compared.values()) / len(train) / len(queries))


def test_nearest_leaves_rows_of_a_cell_out(spark, monkeypatch):
    """One cell holds all; before, its queries were compared with every row of it."""
    monkeypatch.setattr(models, "CELLS", 1)
    monkeypatch.setattr(models, "COLUMNS", 32)
    r = random.Random(3)
    at = lambda: [r.uniform(0, 100), float(r.randint(0, 3)), float(r.randint(0, 1))]
    train, queries = [(i, at(), "x") for i in range(1500)], [(10_000 + i, at()) for i in range(100)]
    got = models.nearest(spark.createDataFrame(train, "id long, vector array<double>, label string"), spark.createDataFrame(queries, "id long, vector array<double>"), 5).collect()
    found, compared = {}, {}
    for x in sorted(got, key=lambda x: x.n):
        found.setdefault(x.id, []).append((x.neighbour, x.d))
        compared[x.id] = x.compared
    for i, q in queries:
        want = sorted((math.dist(q, v), j) for j, v, _ in train)[:5]
        assert [j for j, _ in found[i]] == [j for _, j in want] and all(math.isclose(d, w) for (_, d), (w, _) in zip(found[i], want, strict=True))
    assert sum(compared.values()) < 0.3 * len(train) * len(queries)


def _labelled(spark, n=400):
    r = random.Random(4)
    at = {"attack": (0.0, 0.0), "benign": (3.0, 0.0), "tampered": (0.0, 3.0)}
    rows = [(*(r.gauss(x, 1.2) for x in at[y]), y) for y in (r.choice([*at, "benign"]) for _ in range(n))]
    return spark.createDataFrame(rows, "a double, b double, label string")


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_svm_is_calibrated_on_unseen_rows(spark, tmp_path, method):
    rows = _labelled(spark)
    model = models.fit("svm", rows, ["a", "b"], method=method, maxIter=20)
    model.write().overwrite().save(str(tmp_path / "svm"))
    out = models.predicted(PipelineModel.load(str(tmp_path / "svm")), rows).select("label", "prediction_label", "confidence", vector_to_array("probability").alias("p")).collect()
    assert len(out) == 400 and all(math.isclose(sum(x.p), 1) and x.confidence == max(x.p) for x in out)
    assert all(x.p[["attack", "benign", "tampered"].index(x.prediction_label)] == x.confidence for x in out)
    right = [x.label == x.prediction_label for x in out]
    assert sum(right) > 300
    assert abs(sum(x.confidence for x in out) / 400 - sum(right) / 400) < 0.06  # as sure as it is right
    with pytest.raises(ValueError):
        models.fit("svm", rows, ["a", "b"], method="none")


def test_isotonic_by_hand(spark):
    """Margins 1 to 6 with labels 0 1 0 0 1 1: the second to fourth are pooled to 1/3."""
    rows = [(Vectors.dense(float(m)), y) for m, y in zip(range(1, 7), (0.0, 1.0, 0.0, 0.0, 1.0, 1.0), strict=True)]
    df = spark.createDataFrame(rows, ["v", "y"])
    model = IsotonicRegression(featuresCol="v", labelCol="y").fit(df)
    got = [r.prediction for r in model.transform(df).orderBy(vector_to_array("v")[0]).collect()]
    assert [round(x, 9) for x in got] == [0.0, *[round(1 / 3, 9)] * 3, 1.0, 1.0]


def test_platt_targets(spark):
    df = models._platt(spark.createDataFrame([(1.0,), (1.0,), (0.0,)], "y double"), "y")
    assert sorted(r.y for r in df.collect()) == [1 / 3, 3 / 4, 3 / 4]


def test_tree_impurity(spark):
    rows = _labelled(spark, 200)
    trees = [models.fit("dt", rows, ["a", "b"], impurity=x).stages[-1].toDebugString for x in ("log_loss", "entropy")]
    assert trees[0].split("\n")[1:] == trees[1].split("\n")[1:]


def test_scaled_by_the_training_rows(spark):
    train = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "a double, b double")
    _, rows = models.scaled_vectors(train, spark.createDataFrame([(4.0, 5.0)], "a double, b double"), ["a", "b"])
    a, b = rows.select(F.col("vector")).first()[0]
    assert math.isclose(a, 4 / math.sqrt(2)) and b == 0  # a column of one value counts for nothing


def test_svm_fits_run_together_and_margins_are_written_once(spark, monkeypatch):
    """The SVMs of classes and folds wait for each other's driver no longer; curves read two numbers a row, not the rows."""
    import threading

    running, most, tables = [0], [0], []
    lock, alone, written_before = threading.Lock(), models.LinearSVC.fit, models.written

    def fit(self, df, params=None):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return alone(self, df, params)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(models.LinearSVC, "fit", fit)
    monkeypatch.setattr(models, "written", lambda df, name: (tables.append(df.columns), written_before(df, name))[1])
    train = spark.range(300).selectExpr("cast(id % 7 as double) as a", "cast(id % 5 as double) as b", "if(id % 7 < 3, 'attack', 'benign') as label")
    model = models.fit("svm", train, ["a", "b"], maxIter=5)
    assert 1 < most[0] <= models.FITS
    assert tables == [["_v0", "_y0", "_v1", "_y1"]]
    assert models.predicted(model, train).where("prediction_label = label").count() > 200


def test_forest_rows_keep_their_nodes(spark):
    train = spark.range(400).selectExpr("if(id % 7 < 3, 'a', 'b') as label", "cast(id % 7 as double) as u", "cast(id % 11 as double) as v").coalesce(1)
    dealt = models._dealt(train)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == models.FOREST_TASKS * spark.sparkContext.defaultParallelism and max(sizes) - min(sizes) <= 1
    forest, walked = (models.fit("rf", train, ["u", "v"], numTrees=3, maxDepth=5, **more).stages[-1] for more in ({}, {"cacheNodeIds": False}))
    assert forest.getCacheNodeIds() and forest.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]
