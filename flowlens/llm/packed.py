"""Many records to a row: columns of numbers as bytes, or rows of a table, compressed, by bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PACKED = "kind int, bucket long, data array<binary>"
DEALT = "bucket long, rows binary"
#: Bytes that a task gathers before it deals them.
GATHERED = 48_000_000


def split_by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, the arrays' parts) for each different key; order is kept within."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(heads(key))
    for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True) if len(key) else ():
        yield int(key[a]), [x[order[a:b]] for x in arrays]


def packed(kind: int, rows: list[tuple[int, list[np.ndarray]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(rows), pa.int32()),
            pa.array([k for k, _ in rows], pa.int64()),
            pa.array([[a.tobytes() for a in arrays] for _, arrays in rows], pa.list_(pa.binary())),
        ],
        ["kind", "bucket", "data"],
    )


def unpacked(table, *types) -> list[np.ndarray]:
    rows = table.column("data").to_pylist()
    return [np.concatenate([np.empty(0, t), *(np.frombuffer(r[k], t) for r in rows)]) for k, t in enumerate(types)]


def squeezed(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """Each array as compressed bytes, after their number when not compressed."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return [np.frombuffer(len(r).to_bytes(8, "little") + pa.compress(r, "zstd", asbytes=True), np.uint8) for r in raw]


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def dealt_rows(batches: Iterator[pa.RecordBatch], key: str, buckets: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The batches' rows by their key modulo buckets, many to a row and compressed: shuffles move less than the rows as they are."""
    squeeze, held, size = pa.ipc.IpcWriteOptions(compression="zstd"), [], 0

    def send():
        table = pa.Table.from_batches(held).select(schema.names).cast(schema).combine_chunks()
        out = []
        for bucket, (rows,) in split_by(np.mod(table.column(key).to_numpy(), buckets), np.arange(len(table))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=squeeze) as stream:
                stream.write_table(table.take(pa.array(rows)))
            out.append((bucket, sink.getvalue().to_pybytes()))
        return pa.record_batch([pa.array([b for b, _ in out], pa.int64()), pa.array([r for _, r in out], pa.binary())], ["bucket", "rows"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield send()
            held, size = [], 0
    if held:
        yield send()


def undealt(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of dealt_rows()."""
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(r.as_buffer()).read_all() for r in table.column("rows"))]).combine_chunks()


def heads(values: np.ndarray) -> np.ndarray:
    """Marks the first of each run of equal values."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def spread(count: np.ndarray) -> np.ndarray:
    """0, 1, .., count[0] - 1, 0, 1, .., count[1] - 1, ..."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
