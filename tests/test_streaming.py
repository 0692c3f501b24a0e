"""Flow state over micro-batches: stored measures, a hello in parts, flows in update mode, silence."""

import time

import pandas as pd
import pytest
from flowlens.operators import flows
from flowlens.plans.packets import client_hello, packets
from flowlens.schema import FLOW_COLS
from flowlens.streaming.flows import gathered, running_features, updated_flows
from pyspark.sql import functions as F

from conftest import SMALL


def _append(table, path):
    table.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)  # the file source takes files by time of writing


def _stream(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def _hello_in_parts(spark):
    """A flow whose ClientHello comes in three packets, and HTTP whose head does in two."""
    hello = bytes(spark.range(1).select(client_hello(F.lit("parts.example")).alias("b")).first().b)
    parts = [("10.9.0.1", 50000, 443, hello[:20]), ("10.9.0.1", 50000, 443, hello[20:60]), ("10.9.0.2", 50001, 80, b"GET /y HTTP/1.1\r\nHo"), ("10.9.0.1", 50000, 443, hello[60:]), ("10.9.0.2", 50001, 80, b"st: b.example\r\n\r\n"), ("10.9.0.1", 50000, 443, b"")]
    rows = [(5000 + k, 10**15 + k * k, ip, "10.9.9.9", sport, dport, 6, 6, 100, "PA", data) for k, (ip, sport, dport, data) in enumerate(parts)]
    df = spark.createDataFrame(rows, "frame_no long, ts_us long, ip_src string, ip_dst string, sport int, dport int, l4_proto int, ip_proto int, len_bytes long, tcp_flags string, payload binary")
    return df.withColumns({c: F.lit(None).cast("int") for c in ("ip_version", "ipv4_checksum_ok", "l4_checksum_ok", "ip_flags_mf", "ip_frag_off", "ttl_hlim", "dscp")})


@pytest.fixture(scope="module")
def table(spark):
    parts = _hello_in_parts(spark)
    return packets(spark, SMALL).where("frame_no <= 400").select(parts.columns).unionByName(parts).cache()


def test_state_equals_the_batch(spark, table, tmp_path):
    path = f"{tmp_path}/in"
    for low, high in ((0, 150), (151, 400), (401, 5000), (5001, 5002), (5003, 5003), (5004, 9999)):
        _append(table.where(F.col("frame_no").between(low, high)), path)
    query = running_features(_stream(spark, path)).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    shown = [c for c in got.columns if c.startswith("flow_")]
    want = flows.running(table).where("flow_proto is not null").select("frame_no", *shown)
    assert sorted(map(repr, got.select("frame_no", *shown).collect())) == sorted(map(repr, want.collect()))
    last = {r.frame_no: (r.flow_tls_sni, r.flow_http_host) for r in got.where("frame_no >= 5000").collect()}
    assert [last[5000 + k] for k in range(6)] == [("", ""), ("", ""), ("", ""), ("parts.example", ""), ("", "b.example"), ("parts.example", "")]


def _until(true, seconds=90):
    end = time.time() + seconds
    while not true() and time.time() < end:
        time.sleep(0.2)


def test_changed_flows_and_silence(spark, table, tmp_path):
    path, seen = f"{tmp_path}/in", []
    first, later = table.where("frame_no <= 60"), table.where("frame_no between 61 and 100")
    _append(first, path)
    stream = updated_flows(_stream(spark, path), idle_ms=2000)
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, k: seen.extend(df.select(FLOW_COLS).collect())).start()
    try:
        for part in (first, later):  # by the second, all flows have been silent for longer than is allowed
            want = sorted(map(repr, flows.flows(part).select(FLOW_COLS).collect()))
            _until(lambda: len(seen) >= len(want))
            assert sorted(map(repr, seen)) == want
            time.sleep(12)
            seen.clear()
            if part is first:
                _append(later, path)
    finally:
        query.stop()


def test_accumulators_of_rows_without_values():
    names = [n for n in flows.KINDS if not n.startswith("iat_")]
    rows = pd.DataFrame({"frame_no": [1, 2, 3]} | {f"in_{n}": [None, 5, None] if n not in ("ssh_found", "smb_found") else [None, "x", "y"] for n in names})
    rows["in_end"] = [10, 30, 25]
    out = gathered(rows, {})
    assert out["iat_min_us"].tolist()[1:] == [20, -5] and pd.isna(out["iat_min_us"].iat[0]) and out["ssh_found"].tolist() == [None, "x", "x"]
    assert out["synack_at"].tolist()[1:] == [5, 5] and out["ssh_fallback"].tolist()[1:] == [5, 5]
    more = gathered(rows.assign(frame_no=[4, 5, 6]), dict(out.iloc[-1].where(out.iloc[-1].notna(), None)))
    assert more["iat_min_us"].tolist() == [-15, -15, -15] and more["ssh_found"].tolist() == ["x"] * 3
