"""Document fingerprints: canonical exact digests (DataFrame functions only).

A text's canonical form is its NFKC normal form, case-folded and normalised
again, with every run of white space folded to one blank and none at the ends.
The fingerprint is a wide digest of it: four xxhash64 under different seeds.
Documents with equal fingerprints meet in a bucket, and inside a bucket the
canonical bytes themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import in_order, written

SEEDS = (11, 23, 47, 101)


def _nfkc(text: Column) -> Column:
    return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Normalised, case-folded, white space folded; null counts as empty."""
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), r"[\s\p{Z}\x85\x1c-\x1f]+", " "))


def digest(canon: Column) -> Column:
    """64 lower-case hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0") for s in SEEDS]))


def fingerprint(text: Column) -> Column:
    return digest(canonical(text))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash: the one form in which texts are shuffled, once for all uses."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("text_hash", F.xxhash64("text"))


def followers(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, times, fingerprint, prev_id, prev_hash, prev_chars: documents with their
    predecessors by ascending (doc_id, hash of the text), null ids first; the first follows the last."""
    order = ["doc_id", "text_hash"]
    keys = _texts(docs).select(*order, F.length("text").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"))
    keys = keys.groupBy(*order).agg(F.count("*").alias("times"), F.first("n_chars").alias("n_chars"), F.first("fingerprint").alias("fingerprint"))
    ranged = in_order(keys, order, "order")
    this = F.struct("doc_id", "text_hash", "n_chars")
    ends = ranged.groupBy("_range").agg(F.max(this).alias("last"))
    around = Window.orderBy("_range")  # one row per range
    last = F.last(F.struct("last")).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["last"]
    ends = ends.select("_range", F.coalesce(F.lag("last").over(around), last).alias("_before"))
    own = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    prev = ranged.withColumn("_prev", F.lag(this).over(own)).join(ends, "_range")
    prev = prev.withColumn("_prev", F.coalesce("_prev", "_before"))
    names = {"doc_id": "prev_id", "text_hash": "prev_hash", "n_chars": "prev_chars"}
    return written(prev.select(*order, "times", "fingerprint", *(F.col(f"_prev.{c}").alias(n) for c, n in names.items())), "followers")


def duplicate_groups(docs: DataFrame, order: DataFrame) -> DataFrame:
    """fingerprint, first_doc_id, copies, parts, bytes_sha256 of all groups of two or more documents.

    order: followers(docs).  Only texts in buckets of
    several rows are looked at again.  Grouping by fingerprint and canonical
    text compares the bytes; copies are summed before the shuffle, so a group
    of any size is one row per task.  parts counts the different texts in the
    bucket: more than 1 is a collision of digests, and those texts stay apart.
    """
    multi = order.groupBy("fingerprint").agg(F.sum("times").alias("n")).where("n > 1").select("fingerprint")
    members = order.join(multi, "fingerprint").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "fingerprint")
    texts = _texts(docs).join(members, F.expr("doc_id <=> _id and text_hash = _hash")).withColumn("canon", canonical(F.col("text")))
    exact = texts.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"))
    exact = exact.select("fingerprint", "first_doc_id", "copies", F.sha2("canon", 256).alias("bytes_sha256"))
    return exact.withColumn("parts", F.count("*").over(Window.partitionBy("fingerprint")))


def fingerprint_table(docs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next, bytes_sha256.

    edited is the text with its last floor(n_chars / 4) code points replaced by
    the first as many, or all, of the next document.  An exact digest likens
    texts with 1.0 or 0.0.  order: followers(docs), if it is there already.
    Null texts count as empty; empty texts share one fingerprint.  Rows
    that repeat an id with the same text are one document in this order, and each
    gets its result.  A single document is its own next one; an empty table
    gives an empty table.  Further columns of docs are not looked at.
    """
    order = followers(docs) if order is None else order
    nexts = order.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "fingerprint": "next_fingerprint"}).drop("times")
    heads = _texts(docs).join(nexts, F.expr("doc_id <=> _id and text_hash = _hash")).select(
        "prev_id", "prev_hash", F.left("text", F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"), "next_fingerprint"
    )
    heads = heads.dropDuplicates(["prev_id", "prev_hash"])  # a row, though the follower be repeated
    both = _texts(docs).join(heads, F.expr("doc_id <=> prev_id and text_hash = prev_hash")).drop("prev_id", "prev_hash")
    n = F.length("text")
    both = both.withColumn("n_chars", n.cast("long"))
    both = both.withColumn("edited", F.concat(F.left("text", n - F.floor(n / 4).cast("int")), F.col("head")))
    both = both.withColumn("_canon", canonical(F.col("text"))).withColumn("_canon_edited", canonical(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", "text", "edited", "next_fingerprint",
        digest(F.col("_canon")).alias("fingerprint"), digest(F.col("_canon_edited")).alias("edited_fingerprint"),
        (F.col("_canon") == F.col("_canon_edited")).cast("double").alias("near_edited"),
        F.sha2("_canon", 256).alias("bytes_sha256"),
    ).withColumn("near_next", (F.col("fingerprint") == F.col("next_fingerprint")).cast("double")).drop("next_fingerprint")


def with_copies(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds `copies` and `first_doc_id` from duplicate_groups() to a table with fingerprint and bytes_sha256."""
    g = groups.withColumnsRenamed({"fingerprint": "_print", "bytes_sha256": "_bytes"})
    joined = table.join(g, F.expr("fingerprint = _print and (parts = 1 or bytes_sha256 = _bytes)"), "left")
    return joined.drop("_print", "_bytes", "parts").withColumns(
        {"copies": F.coalesce("copies", F.lit(1)).cast("long"), "first_doc_id": F.coalesce("first_doc_id", "doc_id")}
    )
