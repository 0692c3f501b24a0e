"""Labelled corpora: columns, labels, samples, caps and splits by hash.

Samples, caps and splits take the first rows of each stratum in the order of an
integer hash, so they are exact and the same in every run.  Where that order
ends is found by histograms of the hash: rows are counted by bins, the bin in
which a stratum's quota ends is counted by finer bins, until few enough rows
are left in it to be put in order.  No task holds a stratum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions.header import flag_bits, flag_letters
from flowlens.functions.text import aligned, existing, label_from_score, label_name, number
from flowlens.schema import CLASSES, LABEL_CANDIDATES, TRAIN_FEATURES
from flowlens.sources.shared import written

SAMPLE, PER_FILE, TOTAL, VALIDATION = 0.15, 80_000, 1_500_000, 0.2


def label_column(columns: list[str], wanted: str = "Label") -> str | None:
    """The wanted label column, else the first candidate there is."""
    return wanted if wanted in columns else next((c for c in LABEL_CANDIDATES if c in columns), None)


def train_columns(df: DataFrame, wanted: str = "Label") -> DataFrame:
    keep = [*TRAIN_FEATURES, "tcp_flags", *dict.fromkeys([wanted, *LABEL_CANDIDATES]), "ip_score", "risk_score"]
    return existing(df, keep)


def with_flags(df: DataFrame) -> DataFrame:
    """The six TCP flags as numbers, of tcp_flags as letters or as bits, where there is such a column."""
    if "tcp_flags" not in df.columns:
        return df
    kind = dict(df.dtypes)["tcp_flags"]
    return df.withColumns(flag_letters(F.col("tcp_flags")) if kind == "string" else flag_bits(F.col("tcp_flags")))


def prepared(df: DataFrame, wanted: str = "Label", keys: tuple[str, ...] = ()) -> DataFrame:
    """34 numeric features, 0 where there is no number, and `label`; rows of other labels go."""
    df = with_flags(df)
    name = label_column(df.columns, wanted)
    if name:
        label = label_name(F.col(name), numeric=dict(df.dtypes)[name] != "string")
    else:
        label = label_from_score(*[F.col(c) for c in ("ip_score", "risk_score") if c in df.columns])
    df = aligned(df.withColumn("_label", label), TRAIN_FEATURES)
    out = df.where(F.col("_label").isin(*CLASSES))
    return out.select(*keys, *[number(F.col(c), 0).alias(c) for c in TRAIN_FEATURES], F.col("_label").alias("label"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def row_hash(key: Column, seed: int = 42) -> Column:
    """An integer hash below 2**32 that other engines compute alike; of keys from 2**31 on the lower 31 bits count."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * 2654435761 + seed, F.lit(1 << 32))


#: Most rows of a stratum that are put in order at once; bits by which bins grow finer; most strata sent to every task.
BOUNDARY, BITS, STRATA = 500_000, 12, 20_000


def _same(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns))


def _joined(df: DataFrame, bins: DataFrame, columns: list[str], how: str) -> DataFrame:
    """df with its stratum's row of bins, which names the stratum by the same columns after an underscore."""
    few = bins.limit(STRATA + 1).count() <= STRATA  # bins is a written table
    return df.join(F.broadcast(bins) if few else bins, _same(columns), how).drop(*[f"_{c}" for c in columns])


def _cuts(df: DataFrame, strata: list[str], key: str, quota: Column, seed: int) -> DataFrame:
    """strata (after an underscore), _cut: the last (hash, key) within quota, a column over `_n`, the stratum's rows.
    Strata without any row within their quota are absent."""
    slim = written(df.select(*strata, row_hash(F.col(key), seed).alias("_h"), F.col(key).alias("_key")), "keys")  # read once a round
    under = [F.col(c).alias(f"_{c}") for c in strata]
    # _bin: the hash's leading bits; _want: rows to take of it; _n: rows in it.
    bins = slim.groupBy(*under).agg(F.count("*").alias("_n")).withColumn("_want", F.least(quota.cast("long"), F.col("_n"))).where("_want > 0").withColumn("_bin", F.lit(0).cast("long"))
    bins, bits = written(bins, "strata"), 0
    while bits < 32 and (bins.agg(F.max("_n")).first()[0] or 0) > BOUNDARY:
        left, finer = 32 - bits, min(32, bits + BITS)
        within = _joined(slim, bins.drop("_n"), strata, "inner").where(F.shiftright("_h", left) == F.col("_bin"))
        counts = within.groupBy(*under, "_want", F.shiftright("_h", 32 - finer).alias("_bin")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*[f"_{c}" for c in strata]).orderBy("_bin"))  # 2**BITS rows a stratum at most
        ended = counts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        bins, bits = written(ended.withColumn("_want", F.col("_want") - F.col("_upto") + F.col("_n")).drop("_upto"), "strata"), finer
    last = _joined(slim, bins.drop("_n"), strata, "inner").where(F.shiftright("_h", 32 - bits) == F.col("_bin"))
    order = F.row_number().over(Window.partitionBy(*strata).orderBy("_h", "_key"))
    at = last.withColumn("_k", order).where(F.col("_k") == F.col("_want"))
    return at.select(*under, F.struct("_h", "_key").alias("_cut"))


def first_rows(df: DataFrame, strata: list[str], key: str, quota: Column, seed: int = 42) -> DataFrame:
    """df with boolean `first`: whether a row is among its stratum's quota first ones by hash and key.

    quota is a column over `_n`, the rows of the stratum.  key is an integer, different in all rows;
    rows with a null key are never first.  NULLs make a stratum of their own.
    """
    cuts = written(_cuts(df.where(F.col(key).isNotNull()), strata, key, quota, seed), "cuts")
    own = F.struct(row_hash(F.col(key), seed).alias("_h"), F.col(key).alias("_key"))
    return _joined(df, cuts, strata, "left").withColumn("first", F.coalesce(own <= F.col("_cut"), F.lit(False)) & F.col(key).isNotNull()).drop("_cut")


def stratified(df: DataFrame, strata: list[str], key: str, share: float = SAMPLE, seed: int = 42) -> DataFrame:
    """round(share * n) rows of each stratum; all of them unless 0 < share < 1."""
    if not 0 < share < 1:
        return df
    return first_rows(df, strata, key, F.round(F.col("_n") * share), seed).where("first").drop("first")


def capped(df: DataFrame, group: str, key: str, most: int = PER_FILE, seed: int = 42) -> DataFrame:
    """All rows of a group or `most` of them."""
    return first_rows(df, [group], key, F.lit(most), seed).where("first").drop("first")


def total_cap(df: DataFrame, chunk: list[str], most: int = TOTAL) -> DataFrame:
    """Whole chunks in order until `most` rows are reached; the last may overshoot."""
    sizes = df.groupBy(*chunk).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    kept = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < most)
    return df.join(kept.select(*chunk), chunk, "left_semi")


def split(df: DataFrame, key: str, label: str = "label", share: float = VALIDATION, seed: int = 42) -> DataFrame:
    """Adds `validation`: a share of each label."""
    chosen = first_rows(df, [label], key, F.round(F.col("_n") * share), seed)
    return chosen.withColumn("validation", F.col("first").cast("int")).drop("first")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, weight: n / (classes * n of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))  # one row
    return counts.crossJoin(F.broadcast(totals)).select(label, (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))
