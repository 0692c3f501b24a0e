"""Confusion matrix and classification report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.schema import CLASSES


def confusion(df: DataFrame, y: str = "label", p: str = "prediction", classes: list[str] | None = None) -> DataFrame:
    """A row per true class, a column per predicted one."""
    return df.groupBy(F.col(y).alias("label")).pivot(p, classes or CLASSES).count().na.fill(0)


def report(df: DataFrame, y: str = "label", p: str = "prediction", classes: list[str] | None = None) -> DataFrame:
    """name, precision, recall, f1, support: classes, accuracy, macro and weighted averages; 0 for 0/0."""
    classes = classes or CLASSES
    pairs = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*map(F.lit, classes))).alias("name")
    counted = pairs.select("*", each).groupBy("name").agg(
        F.sum(F.when((F.col("y") == F.col("name")) & (F.col("p") == F.col("name")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("p") == F.col("name"), F.col("n")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("y") == F.col("name"), F.col("n")).otherwise(0)).alias("support"),
        F.sum("n").alias("total"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    rows = counted.withColumns({"precision": ratio("tp", "found"), "recall": ratio("tp", "support")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    rows = rows.withColumn("f1", f1)
    cols = ["precision", "recall", "f1"]
    accuracy = F.sum("tp") / F.max("total")
    macro = rows.agg(*[F.avg(c).alias(c) for c in cols], F.max("total").alias("support")).select(F.lit("macro avg").alias("name"), *cols, "support")
    weighted = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in cols], F.max("total").alias("support")).select(F.lit("weighted avg").alias("name"), *cols, "support")
    overall = rows.agg(*[accuracy.alias(c) for c in cols], F.max("total").alias("support")).select(F.lit("accuracy").alias("name"), *cols, "support")
    parts = [rows.select("name", *cols, "support"), overall, macro, weighted]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("name", *[F.round(c, 4).alias(c) for c in cols], "support")
