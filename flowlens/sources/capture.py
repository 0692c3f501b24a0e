"""Capture files as a data source: byte-range splits, a stream that follows growing files, a committing writer.

A pcap file has no marks between records, so a split cannot see where one starts.
Every place in a window before the split that could be a record header is
followed, header by header, to the split; the true records are among them.  Where
all arrive at one place, that is the border; otherwise the window grows, at most
to the head of the file, from which the way is certain.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, at long, frame_no long, ts_us long, wire_bytes long, frame binary"
HEAD, RECORD = 24, 16
#: The largest record that a capture may hold, and the first window before a split.
LARGEST, WINDOW = 1 << 18, 1 << 19
#: Bytes read at once; rows of an Arrow batch.
READ, ROWS = 1 << 20, 4096
#: Magic bytes: byte order, parts of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9)}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def captures(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the capture files in a folder, or of one file, in order of path."""
    from pyarrow import fs

    system, at = _system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class Capture:
    """An open capture file; a block of it is held at a time."""

    def __init__(self, path: str, size: int | None = None):
        system, at = _system(path)
        self.file = system.open_input_file(at)
        self.size = self.file.size() if size is None else min(size, self.file.size())
        magic = self.read(0, 4)
        self.known = magic in MAGIC
        self.order, self.unit = MAGIC.get(magic, ("<", 10**6))
        self.start, self.block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def bytes_at(self, at: int, n: int) -> bytes:
        """n bytes, of the block that is held where it has them."""
        if not (self.start <= at and at + n <= self.start + len(self.block)):
            self.start, self.block = at, self.read(at, max(n, READ))
        return self.block[at - self.start : at - self.start + n]

    def header(self, at: int) -> tuple[int, int, int] | None:
        """(microseconds, captured bytes, bytes on the wire) of the record at a place; None where none is whole."""
        if at + RECORD > self.size:
            return None
        sec, part, size, wire = struct.unpack(self.order + "IIII", self.bytes_at(at, RECORD))
        if at + RECORD + size > self.size:
            return None
        if size > LARGEST:
            raise ValueError(f"no record at byte {at} of the capture: {size} bytes")
        return sec * 10**6 + part * 10**6 // self.unit, size, wire

    def records(self, at: int, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(place, microseconds, bytes on the wire, frame) of the records that start from at on, before stop."""
        while at < stop and (head := self.header(at)):
            ts, size, wire = head
            yield at, ts, wire, self.bytes_at(at + RECORD, size)
            at += RECORD + size

    def border(self, start: int, window: int = WINDOW) -> int:
        """The place of the first record that starts at or behind start; window is longer than any record."""
        while True:
            base = max(HEAD, start - window)
            if base == HEAD or start <= HEAD:
                at = HEAD
                while at < start and (head := self.header(at)):
                    at += RECORD + head[1]
                return at if at >= start else self.size
            found = self._arrivals(base, start)
            if len(found) == 1:
                return found.pop()
            window *= 4

    def _arrivals(self, base: int, start: int) -> set[int]:
        """Where the chains of headers that may begin from base on first reach start."""
        data = self.read(base, start - base + RECORD)
        kind = np.dtype(self.order + "u4")
        words = [np.concatenate([np.frombuffer(data[k:], kind, (len(data) - k) // 4) for k in range(4)])]
        places = np.concatenate([np.arange(k, len(data) - 3, 4)[: (len(data) - k) // 4] for k in range(4)])
        word = np.zeros(len(data) - 3, np.int64)
        word[places] = words[0]
        n = max(0, min(start - base, len(word) - 12))
        part, size, wire = word[4 : n + 4], word[8 : n + 8], word[12 : n + 12]
        able = (part < self.unit) & (size > 0) & (size <= LARGEST) & (size <= wire)
        arrives: dict[int, int] = {}
        for k in np.flatnonzero(able)[::-1].tolist():
            nxt = k + RECORD + int(size[k])
            if base + nxt >= start:
                if self._able(base + nxt):
                    arrives[k] = base + nxt
            elif nxt in arrives:
                arrives[k] = arrives[nxt]
        return set(arrives.values())

    def _able(self, at: int) -> bool:
        if at + RECORD > self.size:
            return True  # the end, or a record cut off there
        _, part, size, wire = struct.unpack(self.order + "IIII", self.read(at, RECORD))
        return part < self.unit and 0 < size <= min(LARGEST, wire)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    stop: int
    size: int
    first: int | None = None  # number of the first frame, where it is known
    window: int = WINDOW

    def __post_init__(self):
        super().__init__(self.start)


def _batches(split: Split) -> Iterator[pa.RecordBatch]:
    capture = Capture(split.path, split.size)
    if not capture.known:
        return
    at = split.start if split.first is not None else capture.border(split.start, split.window)
    rows, held, number = [], 0, split.first
    for place, ts, wire, frame in capture.records(at, split.stop):
        rows.append((place, number, ts, wire, frame))
        number = None if number is None else number + 1
        held += len(frame)
        if len(rows) == ROWS or held > 8 * READ:
            yield _batch(split.path, rows)
            rows, held = [], 0
    if rows:
        yield _batch(split.path, rows)


def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    place, number, ts, wire, frame = zip(*rows, strict=True)
    arrays = [pa.array([path] * len(rows)), *[pa.array(x, pa.int64()) for x in (place, number, ts, wire)], pa.array(frame, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["path", "at", "frame_no", "ts_us", "wire_bytes", "frame"])


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 64 << 20))
        self.window = max(LARGEST + RECORD, int(options.get("windowbytes", WINDOW)))

    def partitions(self) -> list[Split]:
        return [Split(path, at, min(at + self.split, size), size, window=self.window) for path, size in captures(self.path) for at in range(0, size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _batches(partition)


class CaptureStream(DataSourceStreamReader):
    """Frames in order of path and place, numbered on from 1; a micro-batch has at most framesPerTrigger.

    The offset is a path, a place in it and the frames before.  Only headers are
    walked to find the next one.  A record that is not whole yet waits, and a
    file that has grown goes on; later files must come later in order of path.
    """

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("framespertrigger", 1_000_000))
        self.piece = int(options.get("splitframes", 50_000))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"path": "", "at": 0, "frames": 0}

    def _walk(self, start: dict, end: dict | None) -> tuple[list[Split], dict]:
        """Pieces behind start, up to end or to as many frames as a micro-batch takes, and where that is."""
        splits, here, left = [], dict(start), self.most
        for path, size in captures(self.path):
            if path < here["path"] or end and path > end["path"] or not left:
                continue
            if path > here["path"]:
                here |= {"path": path, "at": HEAD}
            capture = Capture(path, end["at"] if end and path == end["path"] else size)
            while capture.known and left:
                at, n = here["at"], 0
                while n < min(self.piece, left) and (head := capture.header(at)):
                    at, n = at + RECORD + head[1], n + 1
                if not n:
                    break
                splits.append(Split(path, here["at"], at, size, here["frames"] + 1))
                here |= {"at": at, "frames": here["frames"] + n}
                left -= 0 if end else n
        return splits, here

    def latestOffset(self) -> dict:
        self.at = self._walk(self.at or self.initialOffset(), None)[1]
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Split]:
        self.at = end if self.at is None or self.at["frames"] < end["frames"] else self.at
        return self._walk(start, end)[0]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class CaptureWriter(DataSourceWriter):
    """A pcap file per task, under a hidden name until the job commits; rows need ts_us and frame, wire_bytes if there is one.

    Rows are written in the order of their partition, and partitions' files are
    named in order.
    """

    def __init__(self, options: dict, names: list[str]):
        self.path, self.names, self.job = options["path"], names, uuid.uuid4().hex[:8]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        system, folder = _system(self.path)
        name = f"part-{TaskContext.get().partitionId():06d}-{self.job}.pcap"
        hidden, out = f"{folder}/.{name}.{uuid.uuid4().hex}", None
        wire = self.names.index("wire_bytes") if "wire_bytes" in self.names else None
        at_ts, at_frame = self.names.index("ts_us"), self.names.index("frame")
        for row in iterator:
            if out is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(hidden)
                out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LARGEST, 1))
            ts, frame = row[at_ts], bytes(row[at_frame])
            size = len(frame) if wire is None or row[wire] is None else row[wire]
            out.write(struct.pack("<IIII", *divmod(ts, 10**6), len(frame), max(size, len(frame))) + frame)
        if out is None:
            return Written(None)
        out.close()
        return Written(hidden)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None and m.name:
                folder, _, hidden = m.name.rpartition("/")
                system.move(m.name, f"{folder}/{hidden[1:].rpartition('.')[0]}")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None and m.name:
                system.delete_file(m.name)


class CaptureSource(DataSource):
    """spark.read, readStream and write.format("capture"), with the options path and splitBytes, or framesPerTrigger.

    Rows: path, at (the record's place), frame_no (of streams; NULL in batches,
    where numbered() counts), ts_us, wire_bytes and frame.  A record cut off at the
    end is left out; files of another kind have no rows.  Files are read through
    pyarrow's file systems.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self._options())

    def streamReader(self, schema) -> CaptureStream:
        return CaptureStream(self._options())

    def writer(self, schema, overwrite: bool) -> CaptureWriter:
        if overwrite:
            raise ValueError("captures are appended: mode('append')")
        return CaptureWriter(self._options(), schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureSource)


__all__ = ["Capture", "CaptureSource", "captures", "register"]
