"""Token ids of many texts inside tasks, and the byte-plane file format.

Distinct pieces of text are encoded once and remembered: pieces end before a
single blank between two other characters, where the vocabulary's pattern never
joins anything, so their ids put together are the ids of the whole text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.llm.common import partitions, shared_path, written

#: Remembered pieces of each kind; beyond that, they are the older ones, and what is older still is forgotten.
REMEMBERED = 250_000
_ODD = re.compile(r"[^\S \n]")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?"
#: Marks that may also stand in runs behind a word; an apostrophe may begin a token with letters.
_RUNS = _MARKS + '"#$%&()*+-/<=>@[\\]^_`{|}~'
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones by themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _in_pieces(file: dict) -> bool:
    """Whether a tokenizers file splits texts as the pieces and words here assume."""
    split, model = file["pre_tokenizer"] or {}, file["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain = plain and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    words = (t["content"] for t in file["added_tokens"])
    apart = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]) and not any(w.isalpha() or w in _MARKS or set(w) & set(" \n") for w in words)
    return plain and apart and not (file["normalizer"] or file["truncation"] or file["padding"])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a byte-level tokenizers file.

    Of a new piece, a word, the run of marks behind it and line feeds are tokens
    apart in any such vocabulary, so the words go to the file's model one by one,
    once each; whatever is not letters goes through the whole tokenizer, and so
    does what holds marks that the file's added tokens have.  Files of
    another kind (not byte-level, or with a normaliser, or with tokens that
    take in blanks) encode text by text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        file = json.loads(self.tokenizer.to_str())
        self.in_pieces = _in_pieces(file)
        added = {c for t in file["added_tokens"] for c in t["content"]}
        self.tails = "".join(c for c in _RUNS if c not in added)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}  # pieces at the start of a text or line
        self.inner: dict[str, bytes] = {}  # pieces behind a blank, without it
        self.older: dict[bool, dict[str, bytes]] = {False: {}, True: {}}  # of both, by whether behind a blank
        self.marks = {"": b"", "\n": self._whole(["\n"])[0]}  # runs of marks

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str, blank: bool) -> bytes:
        """Ids of letters, behind a blank or not."""
        known = self.inner if blank else self.known
        ids = known.get(word)
        if ids is None:
            ids = self.older[blank].get(word)
            if ids is None:
                spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                found = self.model.tokenize(self.letters[32] + spelt if blank else spelt)
                ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
            known[word] = ids
        return ids

    def _run(self, marks: str) -> bytes:
        ids = self.marks.get(marks)
        if ids is None:
            ids = self._whole([marks])[0]
            if len(marks) <= 8 and len(self.marks) < REMEMBERED:
                self.marks[marks] = ids
        return ids

    def _piece(self, piece: str, blank: bool) -> bytes | None:
        """Ids of lines of a word each with a run of marks behind it; None for anything else."""
        out = []
        for line in piece.split("\n"):
            word = line.rstrip(self.tails)
            if not word.isalpha():
                return None
            out.append(self._word(word, blank) + self._run(line[len(word) :]))
            blank = False
        return self.marks["\n"].join(out)

    def _ids(self, piece: str, blank: bool) -> bytes:
        """Ids of a piece.  Those of more than a line hardly come again and are not remembered."""
        if piece.isalpha():
            return self._word(piece, blank)
        known = self.inner if blank else self.known
        ids = known.get(piece)
        if ids is None:
            ids = self.older[blank].get(piece)
            if ids is None:
                ids = self._piece(piece, blank)
            if ids is None:
                ids = self._whole([" " + piece if blank else piece])[0]
            if "\n" not in piece:
                known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.in_pieces:
            return self._whole(texts)
        if len(self.known) > REMEMBERED:
            self.older[False], self.known = self.known, {}
        if len(self.inner) > REMEMBERED:
            self.older[True], self.inner = self.inner, {}
        out, inner = [], self.inner
        for text in texts:
            odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _ODD.search(text)
            parts = _SAFE.split(text) if odd else text.split(" ")
            ids = list(map(inner.get, parts))
            ids[0] = self._ids(parts[0], False)
            if None in ids:
                for k, known in enumerate(ids):
                    if known is None:
                        ids[k] = self._ids(parts[k], True)
            out.append(b"".join(ids))
        return out


def _texts(batch: pa.RecordBatch, some: int = 64) -> Iterator[tuple[int, list[str]]]:
    """The batch's texts, a few at a time; null is empty."""
    column = batch.column("text")
    for at in range(0, len(column), some):
        yield at, [t or "" for t in column.slice(at, some).to_pylist()]


# -- the file format -------------------------------------------------------

MAGIC = b"BYTEPLNS"
#: Ids of a block.
BLOCK_IDS = 1 << 16
#: Byte planes of 32-bit ids.
PLANES = 4


def to_planes(ids: np.ndarray, level: int = 1) -> tuple[bytes, list[int]]:
    """A block's 4 byte planes, each compressed; and their lengths.  Empty planes have length 0."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, PLANES).T)
    pack = zstandard.ZstdCompressor(level=level)
    out = [pack.compress(p) if p.any() else b"" for p in planes]
    return b"".join(out), [len(p) for p in out]


def from_planes(data: bytes, lengths: list[int], n: int) -> np.ndarray:
    unpack, at = zstandard.ZstdDecompressor(), 0
    planes = np.zeros((PLANES, n), np.uint8)
    for k, size in enumerate(lengths):
        if size:
            planes[k] = np.frombuffer(unpack.decompress(data[at : at + size]), np.uint8)
            at += size
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class PlaneWriter:
    """Magic, blocks, document table, chunk index, place of the two tables.

    The chunk index has a row of unsigned 64-bit numbers per block: place, ids,
    lengths of its 4 planes.  The document table has ids, null marks and
    numbers of tokens.
    """

    def __init__(self, out):
        self.out, self.place = out, 0
        self.held, self.n_held, self.index, self.docs, self.ids = [], 0, [], [], 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.ids += len(ids) // 4
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, stop, BLOCK_IDS):
            block = ids[at : min(at + BLOCK_IDS, stop)]
            data, lengths = to_planes(block)
            self.index.append([self.place, len(block), *lengths])
            self._put(data)
        self.held, self.n_held = [ids[stop:].tobytes()], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        docs, index = self.place, None
        table = np.array(self.docs, "<i8").reshape(-1, 3)
        self._put(zstandard.ZstdCompressor().compress(table.T.tobytes()))
        index = self.place
        self._put(zstandard.ZstdCompressor().compress(np.array(self.index, "<u8").tobytes()))
        self._put(np.array([docs, index, len(self.docs), len(self.index)], "<u8").tobytes())


def read_planes(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a file in order; one block at a time is held, or a document."""
    size = source.size()
    source.seek(size - 32)
    docs, index, n_docs, n_blocks = map(int, np.frombuffer(source.read(32), "<u8"))
    source.seek(docs)
    unpack = zstandard.ZstdDecompressor()
    table = np.frombuffer(unpack.decompress(source.read(index - docs)), "<i8").reshape(3, n_docs)
    rows = np.frombuffer(unpack.decompress(source.read(size - 32 - index)), "<u8").reshape(n_blocks, 2 + PLANES)
    held, block = b"", 0
    for doc_id, null, n in table.T.tolist():
        parts, have = [held], len(held) // 4
        while have < n:
            place, ids, *lengths = map(int, rows[block])
            source.seek(place)
            parts.append(from_planes(source.read(sum(lengths)), lengths, ids).tobytes())
            have, block = have + ids, block + 1
        held = b"".join(parts)
        yield None if null else doc_id, held[: 4 * n]
        held = held[4 * n :]


def _open(path: str, mode: str):
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    if mode == "r":
        return system.open_input_file(at)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Writes the ids of all texts in ascending (doc_id, hash of the text) order, null ids
    first, and gives the manifest: file_no, path, documents, ids.

    A range of documents is a file.  A task writes under a name of its own, and
    only files of finished tasks are in the manifest, so tasks can run again.
    """

    def write(batches):
        name = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.planes"
        encoder, writer, end = Encoder.at(tokenizer), None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in _texts(batch):
                if writer is None:
                    out = _open(name, "w")
                    writer = PlaneWriter(out)
                for doc_id, ids in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), encoder.encode(texts), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": [TaskContext.get().partitionId()], "path": [name], "documents": [len(writer.docs)], "ids": [writer.ids]})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    ranged = texts.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("_hash")
    return written(ranged.mapInArrow(write, "file_no long, path string, documents long, ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit), from the files of a manifest."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                with _open(path, "r") as source:
                    rows, size = [], 0
                    for doc_id, ids in read_planes(source):
                        rows.append((doc_id, start, ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 4_000_000:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    def _rows(rows):
        ids, starts, data = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])

    by_file = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    before = manifest.select("file_no", "path", F.coalesce(F.sum("ids").over(by_file), F.lit(0)).cast("long").alias("before"))
    spread = before.repartition(partitions(manifest.sparkSession), "file_no")
    return spread.select("path", "before").mapInArrow(read, "doc_id long, start long, ids binary")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, ids of every document, written to byte-plane files and read back.

    Null texts are empty and have the end id only.  Rows that repeat an id
    follow each other.  An empty table writes no file and gives no row.  Texts
    are never cut; further columns of docs are not looked at.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, end_id, folder))
