"""What several training-data operators share: tables in the shared folder,
totals in a global order, and names that do not clash with the caller's."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word, as every word-based operator here cuts texts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none, as in tests, a temporary one is set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowlens-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


#: Whether Spark deletes a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and what
    nondeterministic steps made stays as it is when executors are lost.
    Its shuffle files go once it is written: nothing reads them again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parts that rows of one key are dealt to, where a key may hold a third of all rows.
PARTS = 16


def with_hot_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key, by parts of each key's rows.

    right comes PARTS times, so it should be the small side: what was counted by key.
    """
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.lit(PARTS)).cast("int"))
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df as a table dealt out by ranges of `order`, the range number in `_range`.

    The numbers rise with the order, and no range needs rows of another.
    Written down, as sampled range bounds may differ when tasks run again.
    """
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
    return written(ranged.withColumn("_range", F.spark_partition_id()), name)


def with_totals_before(ranged: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of `value` over all rows that stand before a row in the
    order that in_order() dealt by.  Sums meet by range: one row per range."""
    sums = ranged.groupBy("_range").agg(F.sum(value).cast("long").alias("_sum"))
    by_range = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(by_range), F.lit(0)).alias("_offset"))
    own = (
        Window.partitionBy("_range")
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
        .join(offsets, "_range")
        .withColumn(out, (F.col("_own") + F.col("_offset")).cast("long"))
        .drop("_own", "_offset", "_range")
    )
