"""Periodic runs against brute force, and edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from flowlens.llm import catalog, runs
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(words, min_length=6, min_exponent=4):
    out = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            smaller = any(all(words[start + k] == words[start + k + d] for k in range(size - d)) for d in range(1, q))
            if size >= max(min_length, min_exponent * q) and not smaller:
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    drop = {i for start, size, q in found for i in range(start + q, start + size)}
    return [w for i, w in enumerate(words) if i not in drop]


def _random_words(rng):
    n, letters = rng.randrange(70), rng.choice([1, 2, 3, 5])
    words = [b"%d" % rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), 1 + rng.randrange(8)
        words = [w if i < a else words[min(a + (i - a) % p, n - 1)] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("bounds", [(6, 4), (2, 2), (6, 3), (1, 5)])
def test_all_runs_are_found(bounds):
    rng = random.Random(str(bounds))
    for _ in range(1500):
        words = _random_words(rng)
        found = runs.text_runs(words, *bounds)
        assert found == brute(words, *bounds), words
        assert runs.kept_words(words, found) == collapsed(words, found)


def test_comparison_takes_over_where_hashes_fail(monkeypatch):
    rng = random.Random(5)
    texts = [_random_words(rng) for _ in range(300)]
    monkeypatch.setattr(runs, "BASE", 0)  # a hash of the last word only
    monkeypatch.setattr(runs, "_powers", [1])
    for words in texts:
        ids = [int(w) for w in words]
        found = [(a, size, q) for a, size, q in runs._by_comparison(ids, 6, 4)]
        assert sorted(found, key=lambda r: (r[0], r[2])) == brute(words)
        for start, size, q in runs.runs_of(ids, 6, 4):  # what is reported has been compared
            assert (start, size, q) in brute(words)


def test_long_texts():
    for words in ([b"a"] * 30_000, [b"%d" % (i % 7_000) for i in range(30_000)], [b"%d" % i for i in range(10)] * 3_000):
        q = len(set(words))
        assert runs.text_runs(words) == [(0, 30_000, q)]


def test_odd_tables(spark):
    rows = [(None, "a a a a a a a", None, None, None), (1, None, "x", "s", 1), (1, None, "x", "s", 1), (2, "", "x", "s", 1), (3, " \n\t\x0b", "x", "s", 1), (4, "x " * 200_000, "x", "s", 1), (5, "é\u2003é" + " é" * 7 + "\xa0y", "x", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("runs", "row", "n_words", "start"):
        docs = docs.withColumn(c, F.lit("mine"))
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "start", "n_words", "runs", "collapsed"]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.row, r.start) for r in found.collect()]
    assert [g[4:] for g in got] == [("mine", "mine")] * 7
    assert sorted(map(repr, (g[:4] for g in got))) == sorted(map(repr, [
        (None, 7, [(0, 7, 1)], "a"), (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 200_000, [(0, 200_000, 1)], "x"), (5, 8, [(1, 6, 1)], "é\u2003é é é\xa0y"),
    ]))
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_exponent=1)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(w.decode() for w in _random_words(rng)) if i % 9 else None, "en", "s", 0) for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words)
        lines = "".join(f"{a},{size},{q}\n" for a, size, q in found)
        best = min(((-size, a, q) for a, size, q in found), default=None)
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        expected.add((doc_id, len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(collapsed(words, found)).encode()).hexdigest()))
    got = catalog.QUERIES["op11_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {tuple(r) for r in got.collect()} == expected
