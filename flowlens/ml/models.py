"""Classifiers: random forest, decision tree, calibrated linear SVM, nearest neighbours."""

from __future__ import annotations

import json
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from flowlens.functions.text import aligned, confidence_label
from flowlens.ml.prep import class_weights, with_flags
from flowlens.schema import TRAIN_FEATURES
from flowlens.sources.shared import written


def weighted(train: DataFrame) -> DataFrame:
    """Adds `weight`, balanced by class; the weights are a row per class."""
    return train.join(F.broadcast(class_weights(train)), "label")


#: Rows of a partition that a forest is fitted on, about, and partitions a core at least: a fit waits for its slowest task at each level.
FOREST_ROWS, FOREST_TASKS = 50_000, 3


def _dealt(train: DataFrame) -> DataFrame:
    """train in partitions of about FOREST_ROWS rows, evenly, however its files are split."""
    least = FOREST_TASKS * train.sparkSession.sparkContext.defaultParallelism
    return train.repartition(max(least, -(-train.count() // FOREST_ROWS)))


def _stages(features: list[str]) -> list:
    return [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="skip"), VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep")]


def fit(kind: str, train: DataFrame, features: list[str] | None = None, seed: int = 42, **options) -> PipelineModel:
    """A fitted pipeline for kind rf, dt or svm over feature columns and `label`."""
    features = features or TRAIN_FEATURES
    common = {"featuresCol": "x", "labelCol": "y", "weightCol": "weight"}
    if kind == "rf":
        # Rows keep the node they are at in each tree: else every level walks all trees from their roots, which grows with the depth.
        last = [RandomForestClassifier(**common, seed=seed, **({"numTrees": 200, "maxDepth": 20, "cacheNodeIds": True} | options))]
        return Pipeline(stages=[*_stages(features), *last]).fit(_dealt(weighted(train.select("label", *features))))
    elif kind == "dt":
        # Leaves of ten rows leave nothing to a bound of ten rows on what is split.
        if options.get("impurity") == "log_loss":
            options["impurity"] = "entropy"
        last = [DecisionTreeClassifier(**common, seed=seed, **({"maxDepth": 20, "minInstancesPerNode": 10} | options))]
    elif kind == "svm":
        return _calibrated_svm(train, features, **options)
    else:
        raise ValueError(f"no such model: {kind}")
    return Pipeline(stages=[*_stages(features), *last]).fit(weighted(train))


def _platt(df: DataFrame, y: str) -> DataFrame:
    """df with column y of 0 and 1 drawn in from the ends by the numbers of both: 1 / (zeros + 2), (ones + 1) / (ones + 2)."""
    n = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0.0)).alias("ones")).first()
    ones, zeros = n["ones"], n["n"] - n["ones"]
    return df.withColumn(y, F.when(F.col(y) == 1, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2)))


def _calibrated_svm(train: DataFrame, features: list[str], method: str = "sigmoid", folds: int = 3, **options) -> PipelineModel:
    """Scaled features, a linear SVM for each class against the rest, and its margin's calibration to a probability.

    Calibration sees margins of rows that the SVM behind them was not fitted on: rows fall into folds by a hash of
    their features, so equal rows share one, each fold's margins come from an SVM fitted on the others, and the
    pooled margins fit a sigmoid (method "sigmoid", with targets drawn in from 0 and 1) or a monotone step function
    with straight lines between (method "isotonic").  The SVM that scores is fitted on all rows.  Probabilities of a
    row sum to 1; where all are 0, each class gets the same.
    """
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"no such calibration: {method}")
    head = Pipeline(stages=[*_stages(features), StandardScaler(inputCol="x", outputCol="scaled", withMean=False, withStd=True)]).fit(weighted(train))
    classes = range(len(head.stages[0].labels))
    sides = SQLTransformer(statement="SELECT *, " + ", ".join(f"CASE WHEN y = {k} THEN 1.0D ELSE 0.0D END AS _y{k}" for k in classes) + " FROM __THIS__")
    fold = F.pmod(F.xxhash64(*features), F.lit(folds)).alias("_fold")
    rows = sides.transform(head.transform(weighted(train))).select("scaled", "weight", fold, *[f"_y{k}" for k in classes]).persist(StorageLevel.DISK_ONLY)
    svm = {"featuresCol": "scaled", "weightCol": "weight", "maxIter": options.pop("maxIter", 100), "regParam": options.pop("regParam", 1e-4)} | options
    linear = [LinearSVC(labelCol=f"_y{k}", predictionCol=f"_p{k}", rawPredictionCol=f"_m{k}", **svm) for k in classes]
    # The fits do not need each other, and one alone waits for its driver between iterations.
    fits = [(k, i) for k in classes for i in (*range(folds), None)]
    last = []
    try:
        rows.count()  # written down once, ahead of all fits
        with ThreadPool(min(FITS, len(fits))) as pool:
            one = inheritable_thread_target(rows.sparkSession)(lambda of: linear[of[0]].fit(rows if of[1] is None else rows.where(F.col("_fold") != of[1])))
            fitted = dict(zip(fits, pool.map(one, fits, chunksize=1), strict=True))
        margins = [VectorSlicer(inputCol=f"_m{k}", outputCol=f"_v{k}", indices=[1]) for k in classes]
        unseen = [reduce(lambda df, k: margins[k].transform(fitted[k, i].transform(df)), classes, rows.where(F.col("_fold") == i)) for i in range(folds)]  # noqa: B023
        # A curve's fit reads its margins once an iteration: they are written, all classes' in one reading of the rows.
        pooled = written(reduce(DataFrame.unionByName, unseen).select(*[f"{c}{k}" for k in classes for c in ("_v", "_y")]), "margins")
        for k in classes:
            if method == "sigmoid":
                # A small penalty keeps the slope finite where margins part the class from the rest.
                curve = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol=f"_v{k}", labelCol=f"_y{k}", predictionCol=f"_c{k}", regParam=1e-6).fit(_platt(pooled.select(f"_v{k}", f"_y{k}"), f"_y{k}"))
            else:
                curve = IsotonicRegression(featuresCol=f"_v{k}", labelCol=f"_y{k}", predictionCol=f"_c{k}").fit(pooled)
            last += [fitted[k, None], margins[k], curve]
    finally:
        rows.unpersist()
    total = " + ".join(f"_c{k}" for k in classes)
    parts = ", ".join(f"CASE WHEN {total} > 0 THEN _c{k} / ({total}) ELSE 1.0D / {len(classes)} END AS _q{k}" for k in classes)
    best = "CAST(array_position(array({0}), array_max(array({0}))) - 1 AS DOUBLE)".format(", ".join(f"_q{k}" for k in classes))
    shares = [SQLTransformer(statement=f"SELECT *, {parts} FROM __THIS__"), VectorAssembler(inputCols=[f"_q{k}" for k in classes], outputCol="probability"), SQLTransformer(statement=f"SELECT *, {best} AS prediction FROM __THIS__")]
    return PipelineModel([*head.stages, *last, *shares])


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with `prediction_label` and `confidence`, the largest class probability."""
    labels = model.stages[0].labels
    out = model.transform(df if "label" in df.columns else df.withColumn("label", F.lit(labels[0])))
    name = F.element_at(F.array(*map(F.lit, labels)), (F.col("prediction") + 1).cast("int"))
    return out.withColumns({"prediction_label": name, "confidence": F.array_max(vector_to_array("probability"))})


def save(model: PipelineModel, path: str, features: list[str], validated: DataFrame | None = None, **facts) -> None:
    """The model with its facts as JSON and, given label and prediction of rows held out, a report as text; old files are replaced."""
    from flowlens.ml import metrics

    model.write().overwrite().save(f"{path}/model")
    texts = {"meta": json.dumps({"features": features, "classes": model.stages[0].labels, **facts}, indent=2)}
    if validated is not None:
        # Both are small: a row per class or name.
        shown = [("Confusion Matrix:", metrics.confusion(validated).orderBy("label")), ("Classification Report:", metrics.report(validated))]
        texts["report"] = "\n\n".join("\n".join([title, "\t".join(df.columns), *["\t".join(map(str, r)) for r in df.collect()]]) for title, df in shown)
    for name, text in texts.items():
        lines = validated.sparkSession if validated is not None else SparkSession.active()
        lines.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """A saved model and its facts."""
    return PipelineModel.load(f"{path}/model"), json.loads("\n".join(r.value for r in spark.read.text(f"{path}/meta", wholetext=True).collect()))


def matrix(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """features with the model's columns as training has them: flags of tcp_flags, missing columns and numbers 0, 32-bit floats."""
    names = names or TRAIN_FEATURES
    ready = aligned(with_flags(features), names)
    return ready.withColumns({c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in names})


def score(model: PipelineModel, features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """features with `label` by confidence."""
    out = predicted(model, matrix(features, names).drop("label"))
    return out.select(*[c for c in features.columns if c != "label"], confidence_label(F.col("confidence")).alias("label"), "confidence")


#: SVMs that are fitted at the same time.
FITS = 4
#: Queries of a block and training rows of a slice, about; most training rows compared at once; most cells.
BLOCK, SLICE, COLUMNS, CELLS = 20_000, 20_000, 256, 256


def _leaves(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of x in groups of at most `most`, halved at the median of their widest column."""
    left, out = [np.arange(len(x))], []
    while left:
        at = left.pop()
        if len(at) <= most:
            out.append(at)
            continue
        some = x[at]
        by = np.argpartition(some[:, np.argmax(np.ptp(some, axis=0))] if x.shape[1] else np.zeros(len(at)), len(at) // 2)
        left += [at[by[len(at) // 2 :]], at[by[: len(at) // 2]]]
    return [np.sort(at) for at in out if len(at)]


def _squares(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of rows of q from the rows of v at the same places."""
    d = np.zeros(len(q))
    for x, y in zip(q.T, v.T, strict=True):
        d += (x - y) ** 2
    return d


def _gaps(lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least squared distances between boxes lo to hi and boxes low to high, all of the ones from all of the others."""
    d = np.zeros((len(lo), len(low)))
    for a, b, x, y in zip(lo.T, hi.T, low.T, high.T, strict=True):
        d += np.maximum(np.maximum(x[None, :] - b[:, None], a[:, None] - y[None, :]), 0) ** 2
    return d


def _nearest(q: np.ndarray, v: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the k rows of v nearest to each of q, none farther than its bound: places in q, places in v, squared
    distances, the earlier first of equals; and of each of q the rows it was compared with.

    Both are put in boxes.  A row of q sees the nearest box of v, then those not farther than what it has.  A product of
    matrices rules out what is too far by more than its rounding; the rest is measured column by column.
    """
    most = np.full(len(q), np.inf) if bound is None else (bound * (1 + 1e-9) + 1e-9) ** 2
    cells, none = _leaves(v, COLUMNS), np.empty(0, np.int64)
    out, compared = [(none, none, np.empty(0))], np.zeros(len(q), np.int64)
    low, high = (np.array([f(v[c], axis=0) for c in cells]).reshape(len(cells), v.shape[1]) for f in (np.min, np.max))
    for mine in _leaves(q, COLUMNS) if len(cells) else []:
        some, limit = q[mine], most[mine].copy()
        apart = _gaps(some, some, low, high) * (1 - 1e-9)
        first = apart.argmin(1)
        turns = [(c, True) for c in np.unique(first)] + [(c, False) for c in np.argsort(apart.min(0), kind="stable")]
        centre = some.mean(0)
        own = some - centre
        norms = np.einsum("ij,ij->i", own, own)
        i, j, d = none, none, np.empty(0)
        for c, nearest_one in turns:
            ask = np.flatnonzero((apart[:, c] <= limit) & ((first == c) == nearest_one))
            if not len(ask):
                continue
            compared[mine[ask]] += len(cells[c])
            near = v[cells[c]] - centre
            sizes = np.einsum("ij,ij->i", near, near)
            about = norms[ask][:, None] + sizes[None, :] - 2 * (own[ask] @ near.T)
            slack = 1e-11 * (norms[ask] + sizes.max()) + 1e-300
            within = limit[ask]
            if len(cells[c]) > k:
                within = np.minimum(within, np.partition(about, k - 1, axis=1)[:, k - 1] + slack)
            x, y = np.nonzero(about <= (within + slack)[:, None])
            x, y = ask[x], cells[c][y]
            z = _squares(some[x], v[y])
            ok = z <= limit[x]
            i, j, d = np.concatenate([i, x[ok]]), np.concatenate([j, y[ok]]), np.concatenate([d, z[ok]])
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j, d, rank = (a[rank < k] for a in (i, j, d, rank))
            full = rank == k - 1
            limit[i[full]] = np.minimum(limit[i[full]], d[full])
        out.append((mine[i], j, d))
    return (*(np.concatenate(a) for a in zip(*out, strict=True)), compared)


def _points(table: pa.Table | pa.RecordBatch, name: str = "vector") -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all of x from all of y."""
    d = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        d += (a[:, None] - b[None, :]) ** 2
    return np.sqrt(d)


def _searched(asked: DataFrame, known: DataFrame, sizes: dict[int, int], k: int, key: str, kind: str) -> DataFrame:
    """key, neighbour, label, d: the k nearest of each slice of the cells that a query asks, with `of`, the slice's rows, once.

    asked has key, vector, cell, bound, a row for each cell asked; known key, vector, label, cell.  A cell goes in
    slices and its queries in blocks, and a task compares one block with one slice.  Slices with nothing within a
    query's bound give no row.
    """
    asked = written(asked, "asked")
    asking = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row per cell
    table = lambda counts, most: F.element_at(F.array(*[F.lit(max(1, -(-counts.get(c, 0) // most))) for c in range(max([*sizes, *asking, 0]) + 1)]), F.col("cell") + 1)
    slices, blocks = table(sizes, SLICE), table(asking, BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n: F.pmod(F.xxhash64(key), n).cast("int")
    left = asked.select(key, "vector", "cell", "bound", dealt(blocks).alias("block"), each(slices).alias("slice"))
    right = known.where(F.col("cell").isin(*asking)).select(key, "vector", "label", "cell", dealt(slices).alias("slice"), each(blocks).alias("block"))

    def search(some: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(key)
        if not some.num_rows or not rows.num_rows:
            return pa.table({key: some.column(key)[:0], "neighbour": some.column(key)[:0], "label": rows.column("label")[:0], "d": pa.array([], pa.float64()), "of": pa.array([], pa.int64())})
        q, at, d, compared = _nearest(_points(some), _points(rows), k, some.column("bound").to_numpy())
        of = np.zeros(len(q), np.int64)
        one, first = np.unique(q, return_index=True)
        of[first] = compared[one]
        found = pa.array(at)
        return pa.table({key: some.column(key).take(pa.array(q)), "neighbour": rows.column(key).take(found), "label": rows.column("label").take(found), "d": np.sqrt(d), "of": of})

    units = left.groupBy("cell", "block", "slice").cogroup(right.groupBy("cell", "block", "slice"))
    return units.applyInArrow(search, f"{key} {kind}, neighbour {kind}, label string, d double, of long")


def _top(found: DataFrame, k: int, key: str) -> DataFrame:
    own = Window.partitionBy(key)
    ranked = found.withColumns({"n": F.row_number().over(own.orderBy("d", "neighbour")), "compared": F.sum("of").over(own)})
    return ranked.where(F.col("n") <= k).drop("of")


def nearest(train: DataFrame, queries: DataFrame, k: int = 25, key: str = "id") -> DataFrame:
    """key, neighbour, label, d, n from 1, compared (training rows a query was compared with): the exact k nearest.

    Training rows fall into cells, each around the nearest of at most CELLS pivots (the training rows first by a
    hash; they decide cells only).  A query searches its nearest cells until they have k rows; its k-th distance then
    bounds the cells that can hold nearer ones: those whose pivot is not farther than that and the cell's radius,
    whose border with the query's own cell is not farther, and whose box of least and greatest values is not farther.
    Both sides may be of any size, and so may a cell.
    """
    spark, kind = train.sparkSession, dict(queries.dtypes)[key]
    width = len((train.select("vector").first() or [[]])[0])
    picked = train.orderBy(F.xxhash64(key), key).limit(CELLS).select("vector").collect()
    pivots = np.unique(np.array([r[0] for r in picked], dtype=float).reshape(len(picked), width), axis=0)
    if not len(pivots):
        return spark.createDataFrame([], f"{key} {kind}, neighbour {kind}, label string, d double, n int, compared long")

    def placed(batches):
        for batch in batches:
            d = _far(_points(batch), pivots)
            cell = d.argmin(1) if len(d) else np.empty(0, np.int64)
            for name, values in (("cell", cell.astype(np.int32)), ("r", d[np.arange(len(d)), cell])):
                batch = batch.append_column(name, pa.array(values))
            yield batch

    known = written(train.select(key, "vector", "label").mapInArrow(placed, f"{key} {kind}, vector array<double>, label string, cell int, r double"), "cells")
    stats = {r["cell"]: r for r in known.groupBy("cell").agg(F.count("*").alias("rows"), F.max("r").alias("r"), *[f(F.col("vector")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(width)]).collect()}  # CELLS rows at most
    sizes = {c: r["rows"] for c, r in stats.items()}
    cells = np.array(sorted(stats))
    centres, rows, radius = pivots[cells], np.array([sizes[c] for c in cells]), np.array([stats[c]["r"] for c in cells])
    low, high = (np.array([[stats[c][f"{n}{i}"] for i in range(width)] for c in cells], dtype=float).reshape(len(cells), width) for n in ("lo", "hi"))
    apart = _far(centres, centres)

    def first(d: np.ndarray) -> np.ndarray:
        """Which cells a query searches first: the nearest until they have k rows."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(rows[order], axis=1) - rows[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, 1)
        return out

    def chosen(batch, ask: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        q, c = np.nonzero(ask)
        return pa.record_batch({n: batch.column(n).take(pa.array(q)) for n in (key, "vector")} | {"cell": pa.array(cells[c].astype(np.int32)), "bound": pa.array(bound[q])})

    def at_first(batches):
        for batch in batches:
            yield chosen(batch, first(_far(_points(batch), centres)), np.full(batch.num_rows, np.inf))

    def then(batches):
        for batch in batches:
            points, kth = _points(batch), batch.column("bound").to_numpy(zero_copy_only=False)
            d, bound = _far(points, centres), kth[:, None] * (1 + 1e-9) + 1e-9
            own = d.argmin(1) if len(d) else np.empty(0, np.int64)
            nearest_d, between = d.min(1, initial=np.inf)[:, None], apart[own]
            with np.errstate(divide="ignore", invalid="ignore"):
                border = np.where(between > 0, (d**2 - nearest_d**2) / (2 * between), 0.0)
            ask = (d - radius <= bound) & (border <= bound * (1 + 1e-9)) & ~first(d)
            yield chosen(batch, ask & (_gaps(points, points, low, high) <= bound**2), kth)

    asked = queries.select(key, "vector")
    schema = f"{key} {kind}, vector array<double>, cell int, bound double"
    one = written(_top(_searched(asked.mapInArrow(at_first, schema), known, sizes, k, key, kind), k, key), "nearest")
    bounds = one.groupBy(key).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("bound"))
    two = _searched(asked.join(bounds, key).mapInArrow(then, schema), known, sizes, k, key, kind)
    again = one.select(key, "neighbour", "label", "d", F.when(F.col("n") == 1, F.col("compared")).otherwise(0).alias("of"))
    return _top(again.unionByName(two), k, key).select(key, "neighbour", "label", "d", "n", "compared")


def knn(train: DataFrame, queries: DataFrame, k: int = 25, key: str = "id") -> DataFrame:
    """key, prediction of queries by distance-weighted votes of the k nearest training rows.

    Both have key (a unique number) and vector (array of doubles), train also label.
    A training row at distance 0 outvotes the rest; ties go to the alphabet.
    """
    vote = F.when(F.col("d") == 0, F.lit(1e18)).otherwise(1 / F.col("d"))
    votes = nearest(train, queries, k, key).groupBy(key, "label").agg(F.sum(vote).alias("votes"))
    return votes.groupBy(key).agg(F.min(F.struct(-F.col("votes"), F.col("label")))["label"].alias("prediction"))


def scaled_vectors(train: DataFrame, rows: DataFrame, features: list[str] | None = None) -> list[DataFrame]:
    """Both with `vector`: the features by their deviations in train."""
    stages = [VectorAssembler(inputCols=features or TRAIN_FEATURES, outputCol="x", handleInvalid="keep"), StandardScaler(inputCol="x", outputCol="scaled", withMean=False, withStd=True)]
    model = Pipeline(stages=stages).fit(train)
    return [model.transform(df).withColumn("vector", vector_to_array("scaled")) for df in (train, rows)]


__all__ = ["fit", "knn", "load", "matrix", "nearest", "save", "predicted", "scaled_vectors", "score", "weighted"]
