"""The queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import chat, fingerprints, line_dedup, manifest, mixing, neighbours, ngram_join, packing, runs, substring_dedup, token_counts, tokens, toxicity
from flowlens.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixing_table(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path())
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digests)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    order = fingerprints.followers(docs)
    table = fingerprints.fingerprint_table(docs, order).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "bytes_sha256"
    )
    return fingerprints.with_copies(table, fingerprints.duplicate_groups(docs, order)).drop("bytes_sha256")


#: Documents of this remainder are kept from the fit, to test it.
HELD_OUT = 2


def held_out(doc_id) -> object:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("words").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = tokens.token_table(_table(spark, sf_dir, "documents"), tokenizer_path())
    return table.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return turns.withColumn("spans", F.when(F.size("spans") > 0, spans))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "line_count", "lines_removed", "text")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, digest_only=True).withColumn("_best", runs.longest_run(F.col("runs")))
    best = {c: F.col(f"_best.{c}") for c in ("start", "length", "period")}
    milli = F.floor(best["length"] * 1000 / best["period"]).cast("long")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[v.alias(k) for k, v in best.items()], milli.alias("exponent_milli"),
        F.sha2(runs.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    head, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    changed = manifest.tampered(text, F.col("doc_id"))
    other = F.when(changed != text, manifest.leaf_digest(*head, changed))
    leaves = docs.select("doc_id", "source", manifest.leaf_digest(*head, text).alias("leaf"), other.alias("tampered"))
    proved = manifest.merkle_manifest(leaves).withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 2048


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), shared_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_files": op7_token_files,
    "op8_neighbours": op8_neighbours,
    "op9_chat": op9_chat,
    "op10_line_dedup": op10_line_dedup,
    "op11_runs": op11_runs,
    "op12_manifest": op12_manifest,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op9_chat": chat.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op12_manifest": manifest.ORACLE_SQL,
}
