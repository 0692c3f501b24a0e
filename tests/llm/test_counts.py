"""Token counts against the libraries, text by text, and what the cache holds."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import catalog, token_counts
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"
PATHS = {name: public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}
ODD = [
    None, "", " ", "\n\t", "The CAT's  sat, on the\r\nmat\x0b1234 don't!?", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|> <|end oftext|>", "<|endoftext|≯", "é É\ńx äb",
    "ΑΣ ΣΑΣ İI straße ẞ Å Å", "\U0001f600\U0001f44d‍x 中文字 कि ก็", "x" * 5000 + " y" * 5000, "\x1c\x1d\x85﻿​ \xa0 a\x00b", "'s 'S 'll it'LL ''t", "a" * 70 + "\x0c" + "b-" * 40,
    "<|endoftext|≯ ≯ ̸x ́",
]


def _truth(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=PATHS[name])
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(PATHS[name])
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", PATHS)
def test_counts_equal_the_library(spark, tmp_path, name):
    rng, truth = random.Random(4), _truth(name)
    letters = "ab'sSé\u0301 \n\t <|>endoftext1,.!ΣßA\u0338 \u2003"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = token_counts.count_tokens(docs, PATHS[name], f"{tmp_path}/cache").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len((t or "").encode()), truth(t or "")) for i, t in enumerate(texts)}


def test_only_one_kind_goes_in_pieces():
    assert {n: token_counts.Counter.at(p).in_pieces for n, p in PATHS.items()} == {"word_bpe_49k.json": True, "byte_bpe_50k.json": False, "piece_bpe_32k.model": False}


def _cache(spark, path):
    return [(r.tokenizer, bytes(r.digest)) for r in spark.read.schema(token_counts.CACHE).parquet(path).collect()]


def test_each_content_is_encoded_once(spark, tmp_path):
    path, words = f"{tmp_path}/cache", PATHS["word_bpe_49k.json"]
    docs = spark.createDataFrame([(i, "one  two" if i % 2 else "one\ntwo ") for i in range(300)] + [(None, "three"), (7, None), (7, None), (8, "")], SCHEMA).repartition(7)
    first = token_counts.count_tokens(docs, words, path)
    assert len(_cache(spark, path)) == len(set(_cache(spark, path))) == 3  # both spellings are one content
    assert {(r.n_tokens, n) for r, n in ((r, r["count"]) for r in first.groupBy("n_tokens").count().collect())} == {(2, 300), (1, 1), (0, 3)}
    more = docs.union(spark.createDataFrame([(9, "four five six"), (10, "ONE two")], SCHEMA))
    again = token_counts.count_tokens(more, words, path)
    assert len(_cache(spark, path)) == 5 and again.count() == 306
    token_counts.count_tokens(more, words, path)
    assert len(_cache(spark, path)) == 5
    token_counts.count_tokens(docs, PATHS["byte_bpe_50k.json"], path)  # another tokenizer, where blanks count
    assert len(_cache(spark, path)) == 9 and len({t for t, _ in _cache(spark, path)}) == 2


def test_stored_counts_are_used(spark, tmp_path):
    path, words = f"{tmp_path}/cache", PATHS["word_bpe_49k.json"]
    docs = spark.createDataFrame([(1, "known"), (2, "new word")], SCHEMA)
    row = spark.range(1).select(F.lit(token_counts.tokenizer_version(words)).alias("tokenizer"), F.unhex(F.sha2(F.lit("known"), 256)).alias("digest"), F.lit(77).cast("long").alias("n_tokens"))
    for _ in range(2):  # as if two jobs had added it
        row.write.mode("append").partitionBy("tokenizer").parquet(path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, words, path).collect()} == {1: 77, 2: 2}


def test_memory_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED_BYTES", 2_000)
    counter, truth = token_counts.Counter(PATHS["word_bpe_49k.json"]), _truth("word_bpe_49k.json")
    for k in range(200):
        text = " ".join(f"w{k * i} again" for i in range(9)) + " " + "long" * 30
        assert counter.count(text.encode()) == truth(text)
        assert len(counter.known) + len(counter.older) < 60


def test_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")] * 3, SCHEMA)
    for c in ("n_tokens", "digest", "tokenizer", "content"):
        docs = docs.withColumn(c, F.lit("mine"))
    got = token_counts.count_tokens(docs, PATHS["word_bpe_49k.json"], f"{tmp_path}/cache")
    assert got.columns == ["doc_id", "text", "digest", "tokenizer", "content", "n_bytes", "n_tokens"]
    assert [tuple(r) for r in got.collect()] == [(1, "a b", "mine", "mine", "mine", 3, 2)] * 3
    assert token_counts.count_tokens(docs.limit(0), PATHS["word_bpe_49k.json"], f"{tmp_path}/none").count() == 0


def test_query(spark):
    truth = _truth("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = catalog.QUERIES["op13_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {tuple(r) for r in got} == {(i, len(t.encode()), truth(t), truth(t) > 2048) for i, t in texts.items()}
