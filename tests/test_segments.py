"""Flow and address state in segments: any cut gives the same, and one hot key is spread."""

import random

import pytest
from flowlens.operators import flows
from flowlens.operators.features import features, with_address_counts
from flowlens.plans.packets import packets
from pyspark.sql import functions as F

from conftest import SMALL


def _sorted(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture(scope="module")
def table(spark):
    return packets(spark, SMALL).where("frame_no <= 600").cache()


@pytest.mark.parametrize("width", [1, 7, 100])
def test_any_cut_gives_the_same(spark, table, width):
    assert _sorted(flows.flows(table, width)) == _sorted(flows.flows(table))
    assert _sorted(features(table, wide=True, width=width)) == _sorted(features(table, wide=True))


def _giant(spark, n=4000):
    """One TCP flow, times out of order, and what a loop over its packets says."""
    rng = random.Random(9)
    rows, ts, want = [], 0, []
    last, lo, hi, size, syn, synack, ack = None, None, None, 0, 0, None, 0
    for k in range(n):
        ts += rng.randrange(-50, 400)
        flags, length, fwd = rng.choice(["A", "PA", "S" if k > 1500 else "A", "SA" if k > 2000 else "A"]), rng.randrange(60, 1500), rng.random() < 0.5
        ends = ("10.0.0.1", "10.0.0.2", 1000, 80) if fwd else ("10.0.0.2", "10.0.0.1", 80, 1000)
        rows.append((k, ts, *ends, "aa:aa" if k % 997 else f"bb:{k}", 6, length, flags, b"GET /x HTTP/1.1\r\nHost: h\r\n\r\n" if k == 3001 else b""))
        if last is not None:
            lo, hi = min(ts - last, lo if lo is not None else 10**9), max(ts - last, hi if hi is not None else -(10**9))
        last, size, syn = ts, size + length, syn + ("S" in flags)
        ack |= "A" in flags and "S" not in flags and synack is not None
        synack = k if synack is None and flags == "SA" else synack
        want.append((k, k + 1, size, (lo or 0) / 1e6, (hi or 0) / 1e6, (ts - rows[0][1]) / 1e6, syn, int(synack is not None), int(ack), 1 + any(r[4] != rows[0][4] for r in rows[-500:]), int(k >= 3001), "GET" if k >= 3001 else ""))
    schema = "frame_no long, ts_us long, ip_src string, ip_dst string, sport int, dport int, eth_src string, l4_proto int, len_bytes long, tcp_flags string, payload binary"
    more = {c: F.lit(None).cast("int") for c in ("ip_version", "ipv4_checksum_ok", "l4_checksum_ok", "ip_flags_mf", "ip_frag_off", "ttl_hlim", "dscp")}
    return spark.createDataFrame(rows, schema).withColumns(more), want


def test_one_giant_flow_is_spread(spark):
    table, want = _giant(spark)
    width = 128
    shown = "frame_no flow_pkts flow_bytes flow_iat_min flow_iat_max flow_duration flow_syn_count flow_synack_seen flow_ack_seen_after_synack flow_unique_sports flow_http_payload_detected flow_http_method".split()
    got = sorted(tuple(r) for r in flows.running(table, width).select(shown).collect())
    skip = shown.index("flow_unique_sports")
    assert [g[:skip] + g[skip + 1 :] for g in got] == [w[:skip] + w[skip + 1 :] for w in want]
    cut = flows._in_segments(flows.with_proofs(table), width)
    sizes = [r["count"] for r in cut.groupBy("_flow", "_segment").count().collect()]
    assert max(sizes) <= width and len(sizes) == -(-len(want) // width)
    whole = flows.flows(table, width).select([c for c in shown if c != "frame_no"]).collect()
    assert [tuple(r) for r in whole] == [got[-1][1:]]


def test_one_address_with_all_packets(spark):
    rng = random.Random(2)
    rows, seen_macs, seen_ips, want = [], {}, {}, []
    for k in range(3000):
        ip = rng.choice([None, " 1.1.1.1", "1.1.1.1", "1.1.1.1 ", f"2.2.2.{k % 40}"]) if k % 3 else "1.1.1.1"
        mac = rng.choice([None, "AA", "aa", f"m{k % 60}"]) if k % 5 else "Aa"
        rows.append((k, ip, mac))
        if ip is None or mac is None:
            want.append((k, None, 0, 0, 0))
            continue
        i, m = ip.strip(), mac.strip().lower()
        seen_macs.setdefault(i, set()).add(m)
        seen_ips.setdefault(m, set()).add(i)
        a, b = len(seen_macs[i]), len(seen_ips[m])
        want.append((k, int(a <= 1), a, b, int(a > 1 or b > 5)))
    df = spark.createDataFrame(rows, "frame_no long, ip_src string, eth_src string")
    shown = ["frame_no", "src_ip_mac_consistent", "src_ip_mac_seen_mac_count", "src_mac_ip_seen_ip_count", "src_mac_ip_spoof_suspect"]
    for width in (50, 1 << 18):
        assert sorted(tuple(r) for r in with_address_counts(df, width).select(shown).collect()) == want
    assert with_address_counts(df.limit(0)).count() == 0


def test_times_between_over_cuts(spark):
    table, _ = _giant(spark, 500)
    ts = [r.ts_us for r in table.orderBy("frame_no").collect()]
    got = [r.iat_us for r in flows.times_between(table, 16).orderBy("frame_no").collect()]
    assert got == [None] + [b - a for a, b in zip(ts, ts[1:])]
