"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target in words.  A document's expected number of copies
is proportional to its measure, at most `max_copies`, and fills the target of
its source exactly.  The whole part is taken for certain; of the rest p, a
sample is drawn: u being a uniform number from a hash of the row, documents are
ranked by u/(1-u) / (p/(1-p)), random odds divided by inclusion odds, and taken
in that order until the words still due are reached.  The sample's size is thus
fixed in words, the unit of the target.  One more document of the source, that
which fits the remaining gap best, closes it where that comes nearer.

Nothing is sorted whole: ranks meet as sums by bins of the rank key, and only
the bin in which the target is crossed is looked into, in ever finer bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import in_order, with_totals_before, word_count, written

#: Bins per doubling of the rank key, from coarse to fine.
SCALES = (2**6, 2**16)
#: Measures are rounded to this many steps per doubling, so that a source has few levels.
STEPS = 8


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_copies: int = 3) -> DataFrame:
    """Targets by source of (source, size) rows: source, source_size, target.

    Sources in code point order, null last, weigh as `weights`, repeated.  They
    share `share` of all sizes; a target stops at `max_copies` times its
    source's size, and the excess is reshared by weight until none is above.
    """
    own = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    own = own.withColumn("_null", F.col("source").isNull())
    ranked = with_totals_before(in_order(own, ["_null", "source"], "sources"), ["_null", "source"], F.lit(1), "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    goal, level, capped = float(total) * share, 0.0, -1
    while True:  # the set of full sources only grows; each round is one sum over the sources
        full = F.lit(level) * F.col("weight") >= F.col("source_size") * max_copies
        n, filled, free = table.agg(
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("source_size") * max_copies)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (goal - filled) / free
    target = F.least(F.lit(level) * F.col("weight"), F.col("source_size") * F.lit(float(max_copies)))
    return table.select("source", "source_size", target.cast("double").alias("target"))


def _level(size: Column, power: float) -> Column:
    return F.round(F.log2(F.greatest(size, F.lit(1)).cast("double")) * (power * STEPS)).cast("int")


def _measure(level: Column) -> Column:
    return F.pow(F.lit(2.0), level / F.lit(float(STEPS)))


def _row_key(doc_id: Column, text_hash: Column, expected: Column, seed: int) -> Column:
    """log2 of random odds over inclusion odds; null where nothing is to be drawn."""
    u = (F.xxhash64(F.lit(seed), doc_id, text_hash).bitwiseAND(F.lit(2**52 - 1)) + 0.5) / float(2**52)
    p = expected - F.floor(expected)
    return F.when(p > 0, F.log2(u / (1 - u)) - F.log2(p / (1 - p)))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash: all that the decisions need of a document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def _copies_expected(sizes: DataFrame, targets: DataFrame, max_copies: int, power: float) -> DataFrame:
    """source, level, expected: copies per document, by level of the measure.

    Within a source, copies are c times the measure or max_copies; c is found
    by running sums over the levels, from the highest down.
    """
    levels = (
        sizes.where("size > 0")
        .groupBy("source", _level(F.col("size"), power).alias("level"))
        .agg(F.sum("size").cast("double").alias("words"))
        .join(targets, F.expr("source <=> _source"))
        .withColumn("measure", _measure(F.col("level")))
    )
    down = Window.partitionBy("source").orderBy(F.col("level").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("measure") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = F.greatest(F.col("target") - above * max_copies, F.lit(0.0)) / rest
    rates = levels.withColumn("_rate", rate)
    first_fit = F.min(F.when(F.col("_rate") * F.col("measure") <= max_copies + 1e-12, F.struct(-F.col("level"), "_rate")))
    c = first_fit.over(Window.partitionBy("source"))["_rate"]
    expected = F.coalesce(F.least(c * F.col("measure"), F.lit(float(max_copies))), F.lit(float(max_copies)))
    near = F.round(expected)
    exact = F.when(F.abs(expected - near) < 1e-9, near).otherwise(expected)  # rounding errors are no chance
    return rates.select("source", "level", exact.alias("expected"))


def mixing_plan(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_copies: int = 3, power: float = 0.5, seed: int = 17) -> DataFrame:
    """The decisions: _source, source_size, target, level, expected, cut, filler.

    One row per source and level of the measure.  `sizes` as sized() gives.
    """
    targets = source_targets(sizes, weights, share, max_copies)
    aliased = targets.withColumnRenamed("source", "_source")
    levels = written(_copies_expected(sizes, aliased, max_copies, power).withColumnRenamed("source", "_source"), "levels")

    rows = _keyed(sizes, levels, power, seed)
    certain = rows.groupBy("source").agg(F.sum(F.floor("expected") * F.col("size")).alias("_certain"))
    due = (
        certain.join(aliased, F.expr("source <=> _source"))
        .select("_source", (F.col("target") - F.col("_certain")).alias("_due"))
    )
    due = written(due, "due")
    drawn = rows.where("key is not null")
    # Ever finer: the sums of whole bins before the crossing one come off what is due.
    inside, state = drawn, due.withColumn("_upto", F.lit(-math.inf))
    for scale in (*SCALES, None):
        inside = inside.drop("_bin").withColumn("_bin", F.floor(F.col("key") * scale) if scale else F.col("key"))
        sums = inside.groupBy("source", "_bin").agg(F.sum("size").cast("double").alias("_words"), F.max("key").alias("_last"))
        upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        steps = sums.join(state, F.expr("source <=> _source")).withColumn("_run", F.sum("_words").over(upto))
        fits = F.col("_run") <= F.col("_due")
        crossed = steps.groupBy("_source").agg(
            F.max(F.when(fits, F.struct("_run", "_last"))).alias("_fit"),
            F.min(F.when(~fits, F.col("_bin"))).alias("_cross"),
        )
        state = written(
            state.join(crossed.withColumnRenamed("_source", "_s"), F.expr("_source <=> _s"), "left").select(
                "_source",
                (F.col("_due") - F.coalesce(F.col("_fit._run"), F.lit(0.0))).alias("_due"),
                F.greatest(F.col("_upto"), F.coalesce(F.col("_fit._last"), F.col("_upto"))).alias("_upto"),
                F.col("_cross").alias("_cross"),
            ),
            "state",
        )
        if scale:
            bins = state.where("_cross is not null").select(F.col("_source").alias("_s"), "_cross")
            inside = inside.join(bins, F.expr("source <=> _s and _bin = _cross")).drop("_s", "_cross")
            state = state.drop("_cross")
    gaps = state.select(F.col("_source").alias("_s"), "_upto", "_due")
    fill = (
        drawn.join(gaps, F.expr("source <=> _s and key > _upto and abs(_due - size) < _due"))
        .groupBy("_s")
        .agg(F.min(F.struct(F.abs(F.col("_due") - F.col("size")), F.col("key"))).alias("_best"))
        .select("_s", F.col("_best.key").alias("filler"))
    )
    cuts = (
        gaps.withColumnRenamed("_s", "_g")
        .join(fill, F.expr("_g <=> _s"), "left")
        .select("_g", F.col("_upto").alias("cut"), "filler")
    )
    per_source = aliased.join(cuts, F.expr("_source <=> _g"), "left").drop("_g")
    plan = per_source.withColumnRenamed("_source", "_p").join(levels, F.expr("_p <=> _source"), "left")
    return written(plan.select(F.col("_p").alias("_source"), "source_size", "target", "level", "expected", "cut", "filler"), "plan")


def _keyed(sizes: DataFrame, levels: DataFrame, power: float, seed: int) -> DataFrame:
    """Rows of documents with words, their expected copies and rank key."""
    rows = sizes.where("size > 0").withColumn("_level", _level(F.col("size"), power))
    rows = rows.join(levels, F.expr("source <=> _source and _level = level")).drop("_source", "level", "_level")
    return rows.withColumn("key", _row_key(F.col("doc_id"), F.col("text_hash"), F.col("expected"), seed))


def decide(sizes: DataFrame, plan: DataFrame, power: float = 0.5, seed: int = 17) -> DataFrame:
    """sizes with source_size, target, copies and taken (copies times size)."""
    rows = sizes.withColumn("_level", _level(F.col("size"), power))
    zero = plan.groupBy("_source", "source_size", "target").agg(F.lit(1).alias("_one")).drop("_one")
    some = rows.where("size > 0").join(plan, F.expr("source <=> _source and _level = level"))
    key = _row_key(F.col("doc_id"), F.col("text_hash"), F.col("expected"), seed)
    drawn = F.coalesce((key <= F.col("cut")) | (key == F.col("filler")), F.lit(False)).cast("long")
    some = some.withColumn("copies", F.floor("expected") + drawn)
    none = rows.where("size = 0").join(zero, F.expr("source <=> _source")).withColumn("copies", F.lit(0).cast("long"))
    out = [*sizes.columns, "source_size", "target", "copies"]
    both = some.select(*out).unionByName(none.select(*out))
    return both.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_copies: int = 3, power: float = 0.5, seed: int = 17) -> DataFrame:
    """The mixed corpus: rows of `docs`, each as often as the mix takes it.

    docs has doc_id, text, source; further columns pass through, whatever
    their names.  A document's size is its number of words; null and empty
    texts have none and are never taken.  Null sources are one source, the last
    in order.  Rows that repeat an id with the same text are drawn together;
    rows with null ids are told apart by their texts.  Expected copies follow
    size ** power, rounded to eighths of a doubling.  An empty table gives an
    empty table.  Reruns with one seed agree.
    """
    sizes = sized(docs)
    plan = mixing_plan(written(sizes, "sizes"), weights, share, max_copies, power, seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(
        whole,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )
    taken = decide(rows, plan, power, seed).where("copies > 0")
    repeated = taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n"))
    return repeated.select("_doc.*")


def mixing_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs."""
    sizes = written(sized(docs), "sizes")
    power, seed = options.get("power", 0.5), options.get("seed", 17)
    return decide(sizes, mixing_plan(sizes, **options), power, seed).drop("text_hash")
