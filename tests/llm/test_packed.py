"""Rows and numbers that go packed and compressed through shuffles."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from flowlens.llm import packed


def test_texts_are_dealt_compressed(monkeypatch):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.large_string())])
    rows = [{"uid": k * 7 - 900, "doc_id": None if k % 5 == 0 else k, "text": "some words that repeat ä " * 40 + str(k)} for k in range(300)]
    batches = [pa.RecordBatch.from_pylist(rows[a : a + 70], schema.set(2, pa.field("text", pa.string()))) for a in range(0, 300, 70)]
    monkeypatch.setattr(packed, "GATHERED", 100_000)
    out = pa.Table.from_batches(packed.dealt_rows(iter(batches), "uid", 6, schema))
    assert out.column("rows").nbytes < sum(b.nbytes for b in batches) / 4
    back = {}
    for bucket in range(6):
        for r in packed.undealt(out.filter(pa.compute.equal(out.column("bucket"), bucket)), schema).to_pylist():
            assert r["uid"] % 6 == bucket
            back[r["uid"]] = r
    assert [back[r["uid"]] for r in rows] == rows and packed.undealt(out.slice(0, 0), schema).num_rows == 0
    numbers = [np.arange(50) // 9, np.empty(0, np.int64)]
    assert [np.frombuffer(packed.unsqueezed(a.tobytes()), np.int64).tolist() for a in packed.squeezed(numbers)] == [a.tolist() for a in numbers]
