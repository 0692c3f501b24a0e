"""Training files in chunks, logs read back, saved models with their facts."""

import random
import re

import pytest
from flowlens.ml import models
from flowlens.operators import dashboard
from flowlens.operators.features import with_times
from flowlens.operators.flows import flows
from flowlens.plans.packets import packets
from flowlens.sources import log, pcap, tables

from conftest import SMALL
from test_captures import FRAMES, frames
from test_models import _labelled


@pytest.fixture
def splits(spark):
    """Sets the size of splits, and of their blocks, for a test."""

    def set_(size):
        for name, n in (("maxPartitionBytes", size), ("openCostInBytes", 0)):
            spark.conf.set(f"spark.sql.files.{name}", n)

    yield set_
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


@pytest.mark.parametrize("size, blocks", [(1 << 27, 100), (997, 100), (64, 0)])
def test_chunks_by_rows_of_files(spark, tmp_path, splits, monkeypatch, size, blocks):
    monkeypatch.setattr(tables, "BLOCKS", blocks)
    r, want = random.Random(5), set()
    for f, n in (("a", 250), ("b", 1), ("c", 0), ("d", 101)):
        rows = [f"{f}{k}" + "x" * r.randint(0, 40) for k in range(n)]
        (tmp_path / f"{f}.csv").write_text("id,Label\n" + "".join(f"{x},benign\n" for x in rows))
        want |= {(x, k, k // 100) for k, x in enumerate(rows)}
    splits(size)
    got = [(x.id, x.row, x.chunk) for x in tables.read_training(spark, str(tmp_path / "*.csv"), 100).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("size", [1 << 27, 700, 90])
def test_log_read_back(spark, tmp_path, splits, size):
    path = str(tmp_path / "log")
    p = packets(spark, SMALL).where("frame_no <= 150")
    log.write_log(with_times(p), flows(p), path)
    splits(size)
    got = {r.frame_no: r for r in log.read_packets(spark, path).collect()}
    want = {r.frame_no: r for r in p.collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c in "eth_src vlan_id vlan_prio ip_src ip_dst ip_proto ttl_hlim ip_id dscp ipv4_checksum_ok l4_checksum_ok l4_proto sport dport tcp_win".split():
            assert got[k][c] == r[c], (k, c)
        assert bytes(got[k].shown) == bytes(r.payload)[:32] and got[k].shown_bytes == min(32, len(r.payload))
    assert sorted(r.line for r in log.read_flow_lines(spark, path).collect()) == sorted(r.line for r in dashboard.flow_lines(flows(p)).collect())


def test_one_log_with_odd_bytes(spark, tmp_path, splits):
    lines = b"lines of no record\n\n=== Frame 7 ===\nL2: Ethernet src=a dst=b type=0x0806\nTLS SNI=h\xff.x\nHTTP GET host=None path=/\xc3\xbc a\nFrameBytes(2B): 0a ff\n"
    lines += b"\n=== Flow summary ===\n" + b"1.1.1.1:1 -> 2.2.2.2:2 proto=6 pkts=1 bytes=2 dur=0s\n" * 30 + b"\n=== Frame 8 ===\nPayloadPreview(0B): \n"
    (tmp_path / "a.txt").write_bytes(lines)
    splits(50)
    seven, eight = sorted(log.read_packets(spark, str(tmp_path)).collect(), key=lambda r: r.frame_no)
    assert (seven.tls_sni, seven.http_method, seven.http_host, seven.http_path, bytes(seven.shown), seven.eth_type) == ("h�.x", "GET", None, "/ü a", b"\n\xff", "0x0806")
    assert (eight.frame_no, eight.ip_src, eight.tls_sni, bytes(eight.shown), eight.shown_bytes) == (8, None, None, b"", 0)
    assert log.read_flow_lines(spark, str(tmp_path)).count() == 30
    assert log.read_packets(spark, str(tmp_path)).where("frame_no > 8").count() == 0


def test_bytes_of_the_frame(spark):
    decoded = with_times(pcap.decoded(frames(spark)))
    for preview in (5, None):
        got = dict(zip(FRAMES, (r.line.split("\n")[-1] for r in dashboard.frame_lines(decoded, preview).orderBy("frame_no").collect()), strict=True))
        for name, data in FRAMES.items():
            shown = data[:preview]
            assert got[name] == f"{'FrameBytes' if preview is None else 'PayloadPreview'}({len(shown)}B): {shown.hex(' ')}"


def test_saved_model(spark, tmp_path):
    rows, path = _labelled(spark, 200), str(tmp_path / "m")
    model = models.fit("dt", rows, ["a", "b"], maxDepth=3)
    out = models.predicted(model, rows).withColumnRenamed("prediction", "y").withColumnRenamed("prediction_label", "prediction")
    models.save(model, path, ["a", "b"], out.select("label", "prediction"), kind="dt", depth=3)
    models.save(model, path, ["a", "b"], out.select("label", "prediction"), kind="dt", depth=3)  # replaces
    again, facts = models.load(spark, path)
    assert facts == {"features": ["a", "b"], "classes": ["attack", "benign", "tampered"], "kind": "dt", "depth": 3}
    same = lambda m: sorted((r.a, r.prediction) for r in m.transform(rows).collect())
    assert same(again) == same(model)
    text = spark.read.text(f"{path}/report", wholetext=True).first().value
    assert text.startswith("Confusion Matrix:\nlabel\tattack\tbenign\ttampered\nattack\t") and "\n\nClassification Report:\nname\tprecision" in text and "macro avg" in text


def test_log_lines_are_rendered_once(spark, tmp_path, monkeypatch):
    p, path, given, render = packets(spark, SMALL).where("frame_no <= 60"), str(tmp_path / "log"), [], log.frame_lines
    monkeypatch.setattr(log, "frame_lines", lambda df, preview: (given.append(df), render(df, preview))[1])
    monkeypatch.setattr(log, "flow_lines", lambda df: df)
    log.write_log(p, spark.range(1).selectExpr("id as first_frame_no", "'a flow' as line"), path)
    # What finds the bounds of ranges reads the packets, not their lines.
    assert "RepartitionByExpression [frame_no" in given[0]._jdf.queryExecution().optimizedPlan().toString()
    numbers = [int(n) for f in sorted((tmp_path / "log" / "packets").glob("part-*")) for n in re.findall("=== Frame ([0-9]+) ===", f.read_text())]
    assert numbers == list(range(1, 61))
