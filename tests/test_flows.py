"""Properties of flow state, rule tables, parsers and capture files on hand-made rows."""

import struct

import pytest
from flowlens.functions import header, payload, text
from flowlens.operators import dashboard, flows, rules, scores
from flowlens.operators.features import features
from flowlens.plans.packets import NAMELESS_HELLO, packets
from flowlens.schema import FEATURE_COLS, FLOW_COLS
from flowlens.sources import pcap, tables
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import SMALL


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_last_running_row_is_the_flow(spark):
    p = packets(spark, SMALL)
    shown = [c for c in FLOW_COLS if c != "flow_risk_reason"]
    last = flows.running(p).withColumn("_last", F.max("frame_no").over(Window.partitionBy(*flows.KEY))).where("frame_no = _last")
    assert sorted(map(str, last.select(*shown).collect())) == sorted(map(str, flows.flows(p).select(*shown).collect()))


def test_partitions_change_nothing(spark):
    p = packets(spark, SMALL)
    mixed = flows.flows(p.repartition(7, "len_bytes")).orderBy(*flows.KEY).collect()
    assert mixed == flows.flows(p).orderBy(*flows.KEY).collect()


def test_non_flow_packets_have_zero_state(spark):
    p = packets(spark, SMALL).limit(5).withColumn("l4_proto", F.when(F.col("frame_no") > 0, F.lit(None).cast("int")))
    got = features(p).first()
    assert got.flow_pkts == 0 and got.flow_protocol_hint == "unknown" and got.flow_risk_reason == "flow_normal" and features(p).columns == FEATURE_COLS


@pytest.mark.parametrize(
    "change, score, reason",
    [
        ({}, 0, "flow_normal"),
        ({"bad_l4_checksum_count": 1}, 0, "flow_normal"),
        ({"bad_l4_checksum_count": 2}, 5, "flow_normal"),
        ({"bad_l4_checksum_count": 3}, 10, "flow_bad_l4_checksum"),
        ({"syn_count": 4, "ack_count": 0}, 20, "syn_without_ack"),
        ({"syn_count": 3, "ack_count": 0}, 0, "flow_normal"),
        ({"fwd_pkts": 6, "rev_pkts": 0}, 15, "direction_imbalance_no_response"),
        ({"fwd_pkts": 10, "rev_pkts": 2}, 10, "direction_imbalance"),
        ({"fwd_pkts": 10, "rev_pkts": 3}, 0, "flow_normal"),
        ({"duration": 0.5, "pkts": 11}, 10, "short_burst_flow"),
        ({"syn_seen": 1}, 15, "incomplete_handshake_no_synack"),
        ({"syn_seen": 1, "synack_seen": 1}, 12, "incomplete_handshake_no_final_ack"),
    ],
)
def test_flow_rules(spark, change, score, reason):
    names = "bad_ip_checksum_count bad_l4_checksum_count frag_count low_ttl_count unusual_dscp_count syn_count ack_count rst_count syn_seen synack_seen ack_seen_after_synack fwd_pkts rev_pkts unique_dports duration pkts".split()
    row = dict.fromkeys(names, 0) | {"ack_count": 1, "duration": 5.0} | change
    got = rules.with_flow_risk(spark.range(1).select(*[F.lit(v).alias(f"flow_{k}") for k, v in row.items()])).first()
    assert (got.flow_risk_score, got.flow_risk_reason) == (score, reason)


@pytest.mark.parametrize(
    "change, score, reason",
    [
        ({}, 0, "heuristic_normal"),
        ({"ipv4_checksum_ok": None}, 35, "ipv4_checksum_bad"),
        ({"l4_checksum_ok": 0}, 25, "heuristic_normal"),
        ({"l4_checksum_ok": 0, "tcp_flags": "PA"}, 25, "l4_checksum_bad"),
        ({"tcp_flags": "FS"}, 0, "heuristic_normal"),
        ({"tcp_flags": "SF"}, 5, "suspicious_tcp_flags"),
        ({"tcp_flags": None}, 5, "suspicious_tcp_flags"),
        ({"ttl_hlim": 19}, 10, "low_ttl"),
        ({"ttl_hlim": 20}, 0, "heuristic_normal"),
        ({"ttl_hlim": 0}, 0, "heuristic_normal"),
        ({"dscp": 10}, 3, "unusual_dscp"),
        ({"src_ip_mac_consistent": None}, 0, "heuristic_normal"),
        ({"flow_risk_score": 39}, 19, "heuristic_normal"),
        ({"flow_risk_score": 70}, 25, "flow_behavior_suspicious"),
    ],
)
def test_packet_rules(spark, change, score, reason):
    row = {"ipv4_checksum_ok": 1, "l4_checksum_ok": 1, "ip_flags_mf": 0, "ip_frag_off": 0, "ttl_hlim": 64, "dscp": 0, "dport": 1, "tcp_flags": "A",
           "src_ip_mac_consistent": 1, "flow_risk_score": 0, "flow_unique_dports": 1, "flow_syn_count": 0, "flow_ack_count": 1} | change
    cols = [F.lit(v).cast("string" if k == "tcp_flags" else "int").alias(k) for k, v in row.items()]
    got = rules.with_heuristics(rules.coerced(spark.range(1).select(*cols))).first()
    assert (got.heuristic_score, got.heuristic_reason) == (score, reason)


def test_levels_and_labels(spark):
    levels = [r[0] for r in spark.createDataFrame([(x,) for x in (39, 40, 69, 70, 89, 90, 200)], "s int").select(text.risk_level(F.col("s"))).collect()]
    assert levels == ["low", "medium", "medium", "high", "high", "very high", "very high"]
    p = [r[0] for r in spark.createDataFrame([(x,) for x in (0.7999, 0.80, 0.8999, 0.90)], "p double").select(text.confidence_label(F.col("p"))).collect()]
    assert p == ["benign", "tampered", "tampered", "attack"]


def test_checksums(spark):
    head = bytes.fromhex("45000073000040004011b861c0a80001c0a800c7")
    got = one(spark, header.ones_complement(F.lit(b"\x01")).alias("odd"), header.ipv4_checksum_ok(F.lit(head)).alias("ok"),
              header.ipv4_checksum_ok(F.lit(head[:11] + b"\x00" + head[12:])).alias("bad"), header.ipv4_checksum_ok(F.lit(head[:9])).alias("short"))
    assert (got.odd, got.ok, got.bad, got.short) == (0xFEFF, 1, 0, None)


def test_server_name_is_whole_or_none():
    name = b"example.org"
    ext = b"\x00\x00" + struct.pack(">HHBH", len(name) + 5, len(name) + 3, 0, len(name)) + name
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack(">H", len(ext)) + ext
    hello = b"\x01" + len(body).to_bytes(3, "big") + body
    record = b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello
    assert payload.server_name(record) == "example.org"
    assert all(payload.server_name(record[:k]) is None for k in range(len(record)))
    assert payload.server_name(NAMELESS_HELLO) is None and payload.server_name(None) is None


def test_payload_evidence(spark):
    heads = {b"GET /a HTTP/1.1\r\nX: y\r\nhOsT: h \r\n\r\nbody": ("GET", "h", "/a"), b"POST /b HTTP/1.0\r\n\r\n": ("POST", "", "/b"), b"HTTP/1.1 200 OK\r\n\r\n": ("RESP", None, "HTTP/1.1 200 OK"), b"GETX / HTTP": (None, None, None), b"\xff\xfe": (None, None, None)}
    for data, want in heads.items():
        assert payload.http_head(data) == want
        assert tuple(one(spark, payload.http_parse(F.lit(data)).alias("h")).h) == want
    banners = {b"SSH-2.0-x\r\nrest": "SSH-2.0-x", b" SSH-2\xff.0": "SSH-2.0", b"ssh-2": None, b"SSH-" + b"a" * 300: None}
    for data, want in banners.items():
        assert one(spark, payload.ssh_banner(F.lit(data)).alias("b")).b == want
    for data, want in {b"\xfeSMB": "SMB2/3", b"\xffSMB\xfeSMB": "SMB2/3", b"\xffSMB": "SMB1", bytes(124) + b"\xfeSMB": "SMB2/3", bytes(125) + b"\xfeSMB": None}.items():
        assert one(spark, payload.smb_version(F.lit(data)).alias("v")).v == want


def test_split_http_head_and_public_ips(spark):
    e = flows._Evidence()
    e.add(1, 50000, 80, b"GET /x HTTP/1.1\r\nHo")
    e.add(2, 80, 50000, b"st: a\r\n\r\n")
    assert e.result()[:4] == (2, "GET", "a", "/x")
    ips = {"8.8.8.8": True, "10.1.1.1": False, "100.64.0.1": True, "192.0.0.9": True, "256.1.1.1": False, "x": False, "2001:4860:4860::8888": True, "fe80::1": False}
    got = {r.ip: r.p for r in spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", header.public_ip(F.col("ip")).alias("p")).collect()}
    assert got == ips


def test_public_addresses_are_those_of_the_system(spark):
    import ipaddress
    import random

    rng, blocks = random.Random(6), [*header.NOT_PUBLIC_V6, *header.PUBLIC_WITHIN_V6, "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8", "2000::/3", "4000::/3", "::/8", "5f00::/16"]
    some = [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    for b in map(ipaddress.ip_network, blocks):
        lo, hi = int(b.network_address), int(b.broadcast_address)
        some += [str(ipaddress.IPv6Address(max(0, min(2**128 - 1, x)))) for x in (lo - 1, lo, lo + 1, (lo + hi) // 2, hi, hi + 1)]
    some += ["::ffff:8.8.8.8", "::ffff:10.0.0.1", "64:ff9b::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "2001:4860::1%eth0", "2A00::A", " 2a00::1 ", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2a00:0:0:0:0:0:0:1",
             ":", ":::", "1::2::3", "2a00:1", "12345::", "2a00::g", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "::1.2.3.256", "::01.2.3.4", "2a00::%", "2a00:", ":2a00::1", "::1.2.3"]

    def public(text):
        try:
            a = ipaddress.ip_address(text.strip())
        except ValueError:
            return None, False
        return f"{int(a):032x}", not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)

    got = {r.ip: (r.d, r.p) for r in spark.createDataFrame([(i,) for i in some], "ip string").select("ip", header.ipv6_digits(F.trim("ip")).alias("d"), header.public_ip(F.col("ip")).alias("p")).collect()}
    assert {i: g for i, g in got.items() if g != public(i)} == {}


def test_reputation_of_both_families(spark):
    rep = spark.createDataFrame([("2606:4700:4700::1111", '{"scamalytics":{"scamalytics_score":"91"}}')], "ip string, payload string")
    f = spark.createDataFrame([(1, "fe80::1", "2606:4700:4700::1111"), (2, "fe80::1", "fd00::1")], "frame_no long, ip_src string, ip_dst string")
    assert [(r.rep_score, r.rep_level) for r in scores.with_reputation(f, rep).orderBy("frame_no").collect()] == [(91, "very high"), (None, None)]


def test_reputation_order(spark):
    rep = spark.createDataFrame([("9.9.9.9", '{"scamalytics":{"scamalytics_score":"75","scamalytics_risk":" High "}}'), ("9.9.9.8", '{"scamalytics":{"scamalytics_score":"bad"}}'), ("9.9.9.7", '{"scamalytics":{}}')], "ip string, payload string")
    f = spark.createDataFrame([(1, "9.9.9.9", "9.9.9.7"), (2, "9.9.9.9", "1.1.1.1"), (3, "9.9.9.8", "9.9.9.7"), (4, "10.0.0.1", "8.8.8.8")], "frame_no long, ip_src string, ip_dst string")
    got = [tuple(r) for r in scores.with_reputation(f, rep).orderBy("frame_no").select("rep_score", "rep_level", "rep_reason").collect()]
    assert got == [(75, "high", "high"), (75, "high", "public_ip"), (0, "low", "scamalytics_unknown"), (None, None, None)]


def test_capture_file_round_trip(spark, tmp_path):
    frame = bytes.fromhex("0200000000ff020000000001" + "8100" + "6064" + "0800" + "450000280001000040060000" + "0a000001" + "0a000102" + "9c400050" + "0000000000000000" + "5012200000000000")
    frames = spark.createDataFrame([(k, 1_700_000_000_000_000 + k, frame, k % 2) for k in range(1, 5)], "frame_no long, ts_us long, frame binary, part int")
    for r in pcap.pcap_bytes(frames).collect():
        (tmp_path / f"{r.part}.pcap").write_bytes(bytes(r.content) + b"cut off")
    back = pcap.read_pcap(spark, str(tmp_path))
    assert back.count() == 4 and back.agg(F.sum("ts_us")).first()[0] == sum(1_700_000_000_000_000 + k for k in range(1, 5))
    d = pcap.decoded(back).first()
    assert (d.eth_src, d.vlan_id, d.vlan_prio, d.ip_src, d.ip_dst, d.sport, d.dport, d.tcp_flags, d.tcp_win, d.tcp_hdr_len, d.ttl_hlim) == ("02:00:00:00:00:01", 100, 3, "10.0.0.1", "10.0.1.2", 40000, 80, "SA", 8192, 20, 64)


def test_csv_round_trip(spark, tmp_path):
    flow = flows.flows(packets(spark, SMALL)).select(*FLOW_COLS)
    tables.write_csv(flow, str(tmp_path / "flows"))
    back = tables.read_csv(spark, str(tmp_path / "flows"), tables.FLOWS)
    assert back.columns == FLOW_COLS and back.count() == flow.count()
    assert back.agg(F.sum("flow_bytes")).first() == flow.agg(F.sum("flow_bytes")).first()
    assert dashboard.histogram(back, "flow_http_method").first()["value"] == "unknown"
    assert tables.read_training(spark, str(tmp_path / "flows")).where("file is not null").count() == flow.count()


def test_engine_and_training(spark):
    from flowlens.engine import Engine
    from flowlens.plans.training import corpus

    engine = Engine(packets(spark, SMALL).limit(200))
    model = Engine.train("dt", corpus(spark, SMALL), maxDepth=3)
    got = engine.scores(model)
    assert got.count() == 200 and {r.label for r in got.select("label").distinct().collect()} <= {"attack", "tampered", "benign"}
    assert engine.dashboard.top_flows(engine.flows()).count() == 10


def test_frame_lines_of_every_packet(spark):
    from flowlens.plans.catalog import QUERIES

    got = {r.frame_no: r.line.split("\n") for r in QUERIES["frame_log_lines_all"](spark, SMALL).collect()}
    table = packets(spark, SMALL).collect()
    assert set(got) == {r.frame_no for r in table} and len(got) == len(table)
    start, kinds = min(table, key=lambda r: r.frame_no).ts_us, set()
    for r in table:
        lines, data, want = got[r.frame_no], bytes(r.payload), []
        at, since = divmod(r.ts_us, 10**6), abs(r.ts_us - start)
        assert lines[1].startswith(f"ts_epoch={at[0]}.{at[1]:06d} ts_local=2") and f".{at[1] // 1000:03d} t_rel=" in lines[1]
        assert lines[1].endswith(f" t_rel={'-' if r.ts_us < start else ''}{since // 10**6}.{since % 10**6:06d}s")
        if r.l4_proto == 6:
            name, (method, host, path) = payload.server_name(data), payload.http_head(data)
            want = ([f"TLS SNI={name}"] if name else []) + ([f"HTTP {method} host={host} path={path}"] if method else [])
        k = min(32, len(data))
        assert lines[lines.index(next(x for x in lines if x.startswith("  L4_checksum="))) + 1 :] == [*want, f"PayloadPreview({k}B): {data[:k].hex(' ')}"]
        kinds |= {x[:8] for x in want}
    assert kinds == {"TLS SNI=", "HTTP GET", "HTTP RES"}


def test_training_and_scoring_see_one_matrix(spark):
    from flowlens.ml import models, prep
    from flowlens.plans.training import corpus
    from flowlens.schema import TRAIN_FEATURES

    table = corpus(spark, SMALL).where("frame_no <= 300").cache()
    trained = {r.frame_no: r for r in prep.prepared(table, keys=("frame_no",)).collect()}
    scored = {r.frame_no: r for r in models.matrix(table).collect()}
    for k, r in trained.items():
        assert [r[c] for c in TRAIN_FEATURES] == pytest.approx([scored[k][c] for c in TRAIN_FEATURES], rel=1e-6)
    constant = [c for c in TRAIN_FEATURES if len({r[c] for r in trained.values()}) == 1]
    assert not [c for c in constant if c.startswith(("flow_", "tcp_flag_")) and c != "tcp_flag_URG"] and trained


def test_caps_at_full_size(spark):
    from flowlens.plans.catalog import QUERIES
    from flowlens.plans.training import ready

    n = ready(spark, SMALL).count()
    assert QUERIES["per_file_cap_full"](spark, SMALL).count() == QUERIES["global_cap_full"](spark, SMALL).count() == n > 500
