"""Substring dedup: matching statistics against compressed FM-indexes per shard.

Removed is every word in a window of 13 words that also starts in a document
with a smaller id.  A window is sharded by its content: the least hash among the
5-word grams in it, its anchor, decides.  Equal windows have equal anchors, so they meet in a
shard; consecutive windows mostly share theirs, so texts fall into short segments.

  1  Texts are cut into segments; per task, only the smallest document of
     equal segments goes on, the others are known to be repeats.
  2  Anchors that one document alone has are dropped.
  3  What is left of the texts is cut out and dealt to the shards.
  4  A shard is an FM-index over the wavelet tree of its segments' transform.  All windows
     of the segments are streamed against it; where the matching statistic
     reaches 13 words, the least document of the matching suffixes is looked up.
  5  Repeats are merged and taken out of the texts.

Rows are packed, many records to a row, and texts and the words of segments compressed, so shuffles stay below the size of the records.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import partitions, written
from flowlens.llm.fm_index import FMIndex, range_minimum
from flowlens.llm.packed import DEALT, PACKED, dealt_rows, heads, packed, spread, split_by, squeezed, undealt, unpacked, unsqueezed
from flowlens.llm.words import Words, _powers_to, blocks, grams, mix

ANCHOR_WORDS = 5
#: Bytes of text of a bucket, and words of a shard, about.
BUCKET_BYTES, SHARD_WORDS = 24_000_000, 1_500_000
#: Records that a task holds at most before it sums and sends them.
HELD = 1_000_000
_TEXTS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.large_string())])


def _by_bucket(docs: DataFrame, buckets: int):
    """uid, doc_id and text of docs, by bucket of uid, for undealt()."""
    return docs.mapInArrow(lambda batches: dealt_rows(batches, "uid", buckets, _TEXTS), DEALT).groupBy("bucket")


def _segments(words: Words, size: int):
    """(first word, windows, anchor hash, content hash) of the segments of a block."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    g = grams(words.hashes, ANCHOR_WORDS)
    best, arg = g[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, size - ANCHOR_WORDS + 1):
        c = g[k : k + n]
        less = c < best
        best[less], arg[less] = c[less], k
    start = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    place = start + arg[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    windows = np.diff(np.append(at, len(start)))
    first = start[at]
    return first, windows, best[first], _content(words, first, first + windows + size - 1)


def _content(words: Words, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences from start to stop."""
    up, down = _powers_to(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * up[: len(words)])])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def _repeats(content: np.ndarray, doc: np.ndarray):
    """Marks records whose content a smaller document among these has, too."""
    order = np.lexsort((doc, content))
    c, d = content[order], doc[order]
    head = heads(c)
    least = d[np.flatnonzero(head)][np.cumsum(head) - 1]
    out = np.zeros(len(c), bool)
    out[order] = d > least
    return out


def _covers(uid: np.ndarray, start: np.ndarray, stop: np.ndarray, buckets: int, to: int = 1) -> list:
    return packed(to, list(split_by(np.mod(uid, buckets), uid, start.astype(np.int32), stop.astype(np.int32))))


def repeated_spans(docs: DataFrame, size: int = 13, buckets: int | None = None) -> tuple[DataFrame, int]:
    """Packed (uid, first word, word after the last) of all repeats, by bucket of uid; and the number of buckets.

    docs: uid, doc_id, text, with no null ids; uid stands for id and text.
    """
    spark = docs.sparkSession
    n = buckets or max(partitions(spark), -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))

    def cut(batches):
        held: list[tuple] = []

        def send():
            uid, doc, start, windows, anchor, content = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            again = _repeats(content, doc)
            yield _covers(uid[again], start[again], start[again] + windows[again] + size - 1, n)
            go = ~again
            shard = (anchor[go] % np.uint64(n)).astype(np.int64)
            order = np.argsort(uid[go], kind="stable")
            parts = split_by(shard[order], *(x[go][order] for x in (anchor, uid, start.astype(np.int32), windows.astype(np.uint8))))
            yield packed(0, list(parts))

        for batch in batches:
            uid, doc = batch.column("uid").to_numpy(), batch.column("doc_id").to_numpy()
            for at, words in blocks(batch.column("text")):
                first, windows, anchor, content = _segments(words, size)
                row = words.doc[first]
                held.append((uid[at + row], doc[at + row], first - words.first[row], windows, anchor, content))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from send()
        if held:
            yield from send()

    pieces = written(docs.mapInArrow(cut, PACKED), "segments")

    def shared(table: pa.Table) -> pa.Table:
        """Records whose anchor more than one document has, by bucket of the document."""
        anchor, uid, start, windows = unpacked(table, np.uint64, np.int64, np.int32, np.uint8)
        order = np.lexsort((uid, anchor))
        a, u = anchor[order], uid[order]
        head = heads(a)
        group = np.cumsum(head) - 1
        last = np.append(np.flatnonzero(head)[1:], len(a)) - 1 if len(a) else np.empty(0, np.int64)
        many = u[np.flatnonzero(head)] != u[last]
        keep = order[many[group]] if len(a) else order
        words = int(windows[keep].astype(np.int64).sum() + len(keep) * (size - 1))
        rows = list(split_by(np.mod(uid[keep], n), anchor[keep], uid[keep], start[keep], windows[keep]))
        out = pa.Table.from_batches([packed(0, rows)])
        return out.append_column("words", pa.array([words] + [0] * (len(rows) - 1) if rows else [], pa.int64()))

    by_anchor = pieces.where("kind = 0").groupBy("bucket")
    candidates = written(by_anchor.applyInArrow(shared, PACKED + ", words long"), "candidates")
    shards = max(partitions(spark), -(-(candidates.agg(F.sum("words")).first()[0] or 0) // SHARD_WORDS))

    def deal(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = undealt(texts, _TEXTS)
        anchor, uid, start, windows = unpacked(found, np.uint64, np.int64, np.int32, np.uint8)
        out = []
        if len(uid):
            u = texts.column("uid").to_numpy()
            _, rows = np.unique(u, return_index=True)  # rows of one uid have one text
            texts = texts.take(pa.array(rows[np.isin(u[rows], uid)]))
            u, ids = texts.column("uid").to_numpy(), texts.column("doc_id").to_numpy()
            order = np.argsort(uid, kind="stable")
            anchor, uid, start, windows = anchor[order], uid[order], start[order].astype(np.int64), windows[order].astype(np.int64)
            held = []
            for at, words in blocks(texts.column("text")):
                n_texts = len(words.first) - 1
                here = u[at : at + n_texts]  # ascending
                a, b = np.searchsorted(uid, here[0]), np.searchsorted(uid, here[-1], "right")
                row = np.searchsorted(here, uid[a:b])
                first = words.first[row] + start[a:b]
                count = windows[a:b] + size - 1
                inner = spread(count)
                held.append((uid[a:b], ids[at + row], start[a:b], windows[a:b], anchor[a:b], _content(words, first, first + count), words.hashes[np.repeat(first, count) + inner], count))
            uid, doc, start, windows, anchor, content, hashes, count = (np.concatenate(c) for c in zip(*held, strict=True))
            again = _repeats(content, doc)
            if again.any():
                out.append(_covers(uid[again], start[again], start[again] + windows[again] + size - 1, n))
            shard = np.where(again, -1, (mix(anchor) % np.uint64(shards)).astype(np.int64))
            at = np.cumsum(count) - count
            parts = []
            for k, (i,) in split_by(shard, np.arange(len(uid))):
                if k < 0:
                    continue
                c = count[i]
                inner = spread(c)
                vocabulary, code = np.unique(hashes[np.repeat(at[i], c) + inner], return_inverse=True)
                code = code.astype(np.uint16 if len(vocabulary) < 65536 else np.uint32)
                parts.append((k, squeezed([uid[i], doc[i], start[i].astype(np.int32), windows[i].astype(np.uint8), content[i], vocabulary, code])))
            out.append(packed(0, parts))
        return pa.Table.from_batches(out or [packed(0, [])])

    dealt = _by_bucket(docs, n).cogroup(candidates.groupBy("bucket")).applyInArrow(deal, PACKED)
    dealt = written(dealt, "dealt")

    def match(table: pa.Table) -> pa.Table:
        """The shard's index, and the matching statistics of its segments."""
        uid, doc, start, windows, content, word, code = [], [], [], [], [], [], []
        for r in table.column("data").to_pylist():
            r = [*map(unsqueezed, r)]
            v = np.frombuffer(r[5], np.uint64)
            word.append(v[np.frombuffer(r[6], np.uint16 if len(v) < 65536 else np.uint32)])
            for into, raw, t in zip((uid, doc, start, windows, content), r, (np.int64, np.int64, np.int32, np.uint8, np.uint64), strict=False):
                into.append(np.frombuffer(raw, t))
        uid, doc, start, windows, content, word = map(np.concatenate, (uid, doc, start, windows, content, word))
        windows, start = windows.astype(np.int64), start.astype(np.int64)
        # Equal segments are indexed once, with their smallest document.
        _, pick, same = np.unique(content, return_index=True, return_inverse=True)
        least = np.full(len(pick), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc)
        count = windows + size - 1
        at = np.cumsum(count) - count
        c = count[pick]
        inner = spread(c)
        ids = np.unique(word[np.repeat(at[pick], c) + inner], return_inverse=True)[1] + 1
        text = np.zeros(len(ids) + len(pick), np.int64)  # a separator after every segment
        place = np.cumsum(c + 1) - (c + 1)
        text[np.repeat(place, c) + inner] = ids
        index = FMIndex(text, size)
        owner = np.repeat(np.arange(len(pick)), c + 1)
        least_by_suffix = least[owner][index.order]
        w = windows[pick]
        inner = spread(w)
        pattern = np.repeat(place, w) + inner
        found = np.empty(len(pattern), np.int64)
        for a in range(0, len(pattern), 200_000):
            low, high = index.ranges(text, pattern[a : a + 200_000], size)
            found[a : a + 200_000] = range_minimum(least_by_suffix, low, high)
        first = np.cumsum(w) - w
        inner = spread(windows)
        record = np.repeat(np.arange(len(uid)), windows)
        hit = found[first[same][record] + inner] < doc[record]
        record, inner = record[hit], inner[hit]
        new = np.ones(len(record), bool)
        new[1:] = (record[1:] != record[:-1]) | (inner[1:] != inner[:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(record)) - 1 if len(a) else a
        return pa.Table.from_batches([_covers(uid[record[a]], start[record[a]] + inner[a], start[record[b]] + inner[b] + size, n)])

    matched = dealt.where("kind = 0").groupBy("bucket").applyInArrow(match, PACKED)
    known = pieces.where("kind = 1").unionByName(dealt.where("kind = 1"))
    return written(known.unionByName(matched), "repeats"), n


def _without(words: Words, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the block's texts without the removed words, others joined by a blank."""
    keep = np.flatnonzero(~removed)
    delta = np.zeros(len(words.data) + 1, np.int8)
    delta[words.start[keep]] += 1
    np.subtract.at(delta, words.stop[keep], 1)
    mask = np.cumsum(delta[:-1], dtype=np.int8) > 0
    if len(keep):
        last = np.append(words.doc[keep][1:] != words.doc[keep][:-1], True)
        blank = words.stop[keep[~last]]
        data = words.data.copy()
        data[blank] = 0x20
        mask[blank] = True
    else:
        data = words.data
    sizes = np.concatenate([[0], np.cumsum(mask)])
    return data[mask], sizes[words.offsets]


def dedup_substrings(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, words, removed, kept: every text without the words of repeats.

    A window of `size` consecutive words is a repeat if it also starts in a
    document with a smaller id; windows are judged on the input.  kept has the
    other words, joined by single blanks; words and removed are their numbers.
    Null texts have no words.  Null ids are neither smaller nor larger than any:
    such rows neither lose words nor cost others any.  Rows that share an id do
    not cost each other words.  Texts of any length are judged whole; further
    columns of docs are not looked at.  An empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    spans, n = repeated_spans(rows.where("doc_id is not null"), size)

    def take_out(key, texts: pa.Table, found: pa.Table) -> pa.Table:
        texts = undealt(texts, _TEXTS)
        uid, start, stop = unpacked(found, np.int64, np.int32, np.int32)
        order = np.argsort(uid, kind="stable")
        uid, start, stop = uid[order], start[order].astype(np.int64), stop[order].astype(np.int64)
        u = texts.column("uid").to_numpy()
        out = []
        for at, words in blocks(texts.column("text")):
            here = u[at : at + len(words.first) - 1]
            a, b = np.searchsorted(uid, here), np.searchsorted(uid, here, "right")
            row = np.repeat(np.arange(len(here)), b - a)
            span = np.repeat(a, b - a) + spread(b - a)
            delta = np.zeros(len(words) + 1, np.int64)
            np.add.at(delta, words.first[row] + start[span], 1)
            np.add.at(delta, words.first[row] + stop[span], -1)
            removed = np.cumsum(delta[:-1]) > 0
            data, offsets = _without(words, removed)
            gone = np.bincount(words.doc[removed], minlength=len(here))
            kept = pa.LargeStringArray.from_buffers(len(here), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            out.append(pa.record_batch([texts.column("doc_id").slice(at, len(here)).combine_chunks(), pa.array(np.diff(words.first)), pa.array(gone.astype(np.int64)), kept.cast(pa.string())], ["doc_id", "words", "removed", "kept"]))
        empty = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("removed", pa.int64()), ("kept", pa.string())])
        return pa.Table.from_batches(out, None if out else empty)

    return _by_bucket(rows, n).cogroup(spans.groupBy("bucket")).applyInArrow(take_out, "doc_id long, words long, removed long, kept string")
