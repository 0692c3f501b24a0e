"""The capture data source: any split gives the same frames, round trips, growing files."""

import random
import struct
import time

import pytest
from flowlens.sources import capture, pcap


def _file(frames, order="<", unit=10**6, cut=b""):
    magic = {("<", 10**6): 0xA1B2C3D4, ("<", 10**9): 0xA1B23C4D, (">", 10**6): 0xA1B2C3D4}[order, unit]
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 1 << 18, 1)
    for ts, frame in frames:
        out += struct.pack(order + "IIII", ts // 10**6, ts % 10**6 * (unit // 10**6), len(frame), len(frame)) + frame
    return out + cut


def _frames(seed, n=900):
    """Frames of which some hold captures themselves, whole, cut, or ending where the frame does."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        data = rng.randbytes(rng.choice([14, 60, 200, 1500]))
        if k % 5 == 0:
            inner = _file([(k * 1000 + i, rng.randbytes(40)) for i in range(20)])
            data = [inner, inner[24:], inner[24:-7], bytes(300) + inner[24:]][k // 5 % 4]
        out.append((1_700_000_000_000_000 + 777 * k, data))
    return out


@pytest.mark.parametrize(("order", "unit"), [("<", 10**6), (">", 10**6), ("<", 10**9)])
def test_borders_are_certain(tmp_path, order, unit):
    frames = _frames(3, 300)
    (tmp_path / "a.pcap").write_bytes(_file(frames, order, unit, b"cut off"))
    places, at = [], 24
    for _, f in frames:
        places.append(at)
        at += 16 + len(f)
    c = capture.Capture(str(tmp_path / "a.pcap"))
    rng = random.Random(1)
    for start in [0, 24, 25, at - 1, at, *rng.sample(range(24, at), 300)]:
        want = next((p for p in places if p >= start), None)
        for window in (3000, 1 << 19):  # longer than any record
            got = c.border(start, window)
            assert got == want if want is not None else got >= at


def test_splits_change_nothing(spark, tmp_path):
    capture.register(spark)
    want = {}
    for name, seed in (("a.pcap", 1), ("b.pcap", 2), ("empty.pcap", 3)):
        frames = _frames(seed) if seed < 3 else []
        (tmp_path / name).write_bytes(_file(frames))
        want[name] = frames
    (tmp_path / "c.txt").write_bytes(b"no capture at all, but long enough to be read as one")
    size = max(f.stat().st_size for f in tmp_path.iterdir())
    for splits in (1, 3, 50):
        df = spark.read.format("capture").option("splitBytes", -(-size // splits)).load(str(tmp_path))
        assert splits == 1 or df.rdd.getNumPartitions() > splits
        got = {}
        for r in df.orderBy("path", "at").collect():
            got.setdefault(r.path.rpartition("/")[2], []).append((r.ts_us, bytes(r.frame)))
        assert got == {k: v for k, v in want.items() if v}
    numbers = [(r.path.rpartition("/")[2], r.frame_no) for r in pcap.numbered(df).orderBy("frame_no").select("path", "frame_no").collect()]
    assert [n for _, n in numbers] == list(range(1, 1801)) and [p for p, _ in numbers] == ["a.pcap"] * 900 + ["b.pcap"] * 900


def test_written_captures_read_back(spark, tmp_path):
    capture.register(spark)
    frames = _frames(4, 200)
    df = spark.createDataFrame([(k, ts, f, len(f) + 9) for k, (ts, f) in enumerate(frames)], "n long, ts_us long, frame binary, wire_bytes long")
    ordered = df.repartitionByRange(3, "n").sortWithinPartitions("n")
    ordered.write.format("capture").mode("append").save(f"{tmp_path}/out")
    files = capture.captures(f"{tmp_path}/out")
    assert len(files) == 3 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    back = spark.read.format("capture").option("splitBytes", 5000).load(f"{tmp_path}/out").orderBy("path", "at").collect()
    assert [(r.ts_us, bytes(r.frame), r.wire_bytes) for r in back] == [(ts, f, len(f) + 9) for ts, f in frames]

    def fail(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ordered.mapInArrow(fail, df.schema).write.format("capture").mode("append").save(f"{tmp_path}/out")
    assert capture.captures(f"{tmp_path}/out") == files


def test_stream_follows_a_growing_file(spark, tmp_path):
    capture.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    one, two = _frames(5, 120), _frames(6, 80)
    whole = _file(one)
    cut = len(_file(one[:70])) + 11  # inside a record's header
    (folder / "1.pcap").write_bytes(whole[:cut])
    stream = spark.readStream.format("capture").option("framesPerTrigger", 30).option("splitFrames", 7).load(str(folder))
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(processingTime="200 milliseconds").start()
    rows = lambda: spark.read.schema(capture.SCHEMA).parquet(f"{tmp_path}/out") if (tmp_path / "out").exists() else spark.createDataFrame([], capture.SCHEMA)

    def wait(n):
        end = time.time() + 60
        while rows().count() < n and time.time() < end:
            time.sleep(0.5)

    try:
        wait(70)
        assert rows().count() == 70
        (folder / "1.pcap").write_bytes(whole)
        (folder / "2.pcap").write_bytes(_file(two))
        wait(200)
    finally:
        query.stop()
    got = [(r.frame_no, r.ts_us, bytes(r.frame)) for r in rows().orderBy("frame_no").collect()]
    assert got == [(k + 1, ts, f) for k, (ts, f) in enumerate(one + two)]


def test_no_file_is_held_whole(tmp_path, monkeypatch):
    frames = _frames(7, 400)
    (tmp_path / "a.pcap").write_bytes(_file(frames))
    monkeypatch.setattr(capture, "READ", 4096)
    c, held = capture.Capture(str(tmp_path / "a.pcap")), []
    for _ in c.records(24, 10**9):
        held.append(len(c.block))
    assert len(held) == 400 and max(held) <= 4096
