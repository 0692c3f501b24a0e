"""Token counts of whole texts by a cache of digests.

A text's content, in the form that the tokenizer cannot tell from the text, has
a digest, and so has the tokenizer: its file and the library's version.  Counts
are stored under both.  Contents that the cache knows are joined to their
counts; of the others each different one is encoded once and appended.
"""

from __future__ import annotations

import hashlib
import importlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import partitions, written
from flowlens.llm.tokens import _byte_letters

#: Bytes of pieces remembered by a worker in each of two generations, and the longest piece worth it.
REMEMBERED_BYTES = 30_000_000
LONGEST_REMEMBERED = 64
_MARKS = b".,;:!?"
CACHE = "tokenizer string, digest binary, n_tokens long"
_counters: dict[str, Counter] = {}


def _drops_blanks(file: dict) -> bool:
    """Whether a tokenizers file treats any run of blanks as a border between words and nothing else.

    That is so where the normaliser makes a blank of each run of white space and
    works character by character otherwise, the splitter throws away what its
    pattern does not name, the pattern names no white space, and neither model
    nor special tokens reach over it.
    """
    steps = (file["normalizer"] or {}).get("normalizers", [])
    split = ((file["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    folds = any(s["type"] == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    known = all(s["type"] in ("NFC", "Replace", "Lowercase") for s in steps) and sum(s["type"] == "Replace" for s in steps) == 1
    pattern = (split.get("pattern") or {}).get("Regex", " ")
    named = "\\s" in pattern.replace("[^\\s", "") or "." in pattern or any(c in pattern for c in " \t\n") or pattern.replace("[^\\s", "").count("[^")
    drops = split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed" and not named
    apart = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not set(t["content"]) & set(" \t\n\r\x0b\x0c") for t in file["added_tokens"])
    return bool(folds and known and drops and apart and not file["post_processor"] and not (file["model"].get("dropout") or 0))


def _takes_words(file: dict) -> bool:
    """Whether letters without a break are one pre-token, spelt in bytes, and a mark behind them is another."""
    split, *rest = (file["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    kinds = (split.get("pattern") or {}).get("Regex", "").split("|")
    letters, others = "[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"
    if letters not in kinds or kinds[-1] != others or not all(k.startswith("'") for k in kinds[: kinds.index(letters)]):
        return False
    return [(r["type"], r.get("use_regex"), r.get("add_prefix_space")) for r in rest] == [("ByteLevel", False, False)]


class Counter:
    """Numbers of tokens by a tokenizers (.json) or sentencepiece (.model) file, without added tokens."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.in_pieces = self.by_words = False
            self._counts = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            file = json.loads(tokenizer.to_str())
            self.in_pieces = _drops_blanks(file)
            self.by_words = self.in_pieces and _takes_words(file)
            self.model, self.letters = tokenizer.model, _byte_letters()
            self._counts = lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.held = 0
        if self.by_words:
            marks = [bytes([m]) for m in _MARKS]
            self.marks = dict(zip(marks, self._counts([m.decode() for m in marks]), strict=True))

    @classmethod
    def at(cls, path: str) -> Counter:
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def _word(self, piece: bytes) -> int | None:
        """Tokens of Latin letters and perhaps a mark behind them; None for anything else."""
        mark = piece[-1:]
        word = piece[:-1] if mark in self.marks else piece
        if word.isalpha():
            spelt = word.lower().decode()
        else:
            spelt = word.decode()
            if not spelt.isalpha() or max(spelt) > "\xff":
                return None
            spelt = spelt.lower().encode().decode("latin-1").translate(self.letters)
        return len(self.model.tokenize(spelt)) + self.marks.get(mark, 0)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, int]:
        """Counts of pieces.  Short ones are remembered; of those long unseen, the older half is forgotten at times."""
        counts, rest = {}, []
        for p in pieces:
            n = self.older.get(p)
            if n is None and self.by_words and len(p) <= LONGEST_REMEMBERED:
                n = self._word(p)
            if n is None:
                rest.append(p)
            else:
                counts[p] = n
        if rest:
            counts.update(zip(rest, self._counts([p.decode() for p in rest]), strict=True))
        short = {p: n for p, n in counts.items() if len(p) <= LONGEST_REMEMBERED}
        self.held += sum(map(len, short)) + 100 * len(short)
        self.known.update(short)
        if self.held > REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        return counts

    def count(self, text: bytes) -> int:
        """Tokens of a whole text in UTF-8."""
        if not self.in_pieces:
            return self._counts([text.decode()])[0]
        pieces = text.split()
        counts = list(map(self.known.get, pieces))
        if None in counts:
            new = self._learn(list({p for p, n in zip(pieces, counts, strict=True) if n is None}))
            counts = [new[p] if n is None else n for p, n in zip(pieces, counts, strict=True)]
        return sum(counts)


def tokenizer_version(path: str) -> str:
    """Hex sha256 of a tokenizer file and the version of its library."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        said = hashlib.file_digest(f, "sha256").hexdigest()
    return hashlib.sha256(f"{library} {importlib.import_module(library).__version__} {said}".encode()).hexdigest()


def content(text: Column, in_pieces: bool) -> Column:
    """What stands for a text: null is empty; runs of blanks and U+0009 to U+000D are one blank, where the tokenizer drops them."""
    text = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if in_pieces else text


def cached_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """digest, n_tokens of a tokenizer's part of the cache, a row per digest; None where there is none yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # jobs at the same time may both have added one


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest was not there before in the task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for digest in batch.column("digest").to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch if all(keep) else batch.filter(pa.array(keep))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """docs with `n_bytes` (UTF-8) and `n_tokens` long, of whole texts by a tokenizer file; `cache` is a folder all share.

    The cache is read first, and the counts of contents that it lacks are
    appended; a job that fails or a task that runs again leaves no half rows, and
    rows that two jobs append alike count once.  Tokens are those that the file's
    library gives by itself, special strings in texts included, without begin,
    end or added tokens, cut or padding.  Null and empty texts have none and 0
    bytes.  Repeated rows and copies share one count; ids are not looked at.  An
    empty table gives no row.  Columns of docs named like the two new ones are
    replaced; all others pass through.

    Texts are shuffled once, copies inside a task only once, and never sorted;
    memory holds the digests of a task and one batch of texts.  The last join
    has 32 bytes and a count to a row, and adaptive execution splits digests
    that very many rows share.
    """
    spark = docs.sparkSession
    in_pieces = Counter.at(tokenizer).in_pieces
    version = tokenizer_version(tokenizer)
    digest = F.unhex(F.sha2(content(F.col("text"), in_pieces), 256)).alias("digest")

    def encode(batches):
        counter = Counter.at(tokenizer)
        for batch in _first_seen(batches):
            texts = batch.column("content").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([counter.count(t.as_py()) for t in texts], pa.int64())], ["digest", "n_tokens"])

    texts = docs.select(digest, content(F.col("text"), in_pieces).alias("content")).mapInArrow(_first_seen, "digest binary, content string")
    texts = texts.repartition(partitions(spark), "digest")
    known = cached_counts(spark, cache, version)
    if known is not None:
        texts = texts.join(known.select("digest").hint("shuffle_hash"), "digest", "left_anti")
    counts = texts.mapInArrow(encode, "digest binary, n_tokens long").select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    counts.write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = cached_counts(spark, cache, version)
    if counts is not None:
        counts = written(counts, "token-counts-of-all")  # joined as it is read, so that adaptive execution can split frequent digests
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest)
    if counts is None:  # an empty table has added no folder
        return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], "n_bytes", F.lit(0).cast("long").alias("n_tokens"))
    return rows.join(counts, "digest", "left").select(*[F.col(f"_row.`{c}`").alias(c) for c in own], "n_bytes", "n_tokens")
