"""Decoding of captures: IPv6, VLAN stacks, padding, several files, and bytes that are no text."""

import random
import socket
import struct

from flowlens.engine import Engine
from flowlens.functions import payload
from flowlens.operators import dashboard
from flowlens.operators.features import features, with_times
from flowlens.sources import pcap
from pyspark.sql import functions as F

MACS = bytes.fromhex("0200000000ff020000000001")
V4 = bytes.fromhex("450000280001400040060000" + "0a000001" + "0a000102")
V6 = bytes.fromhex("6b800000" + "0018" + "06" + "37") + socket.inet_pton(socket.AF_INET6, "2001:db8::1") + socket.inet_pton(socket.AF_INET6, "fe80::2")
TCP = bytes.fromhex("9c400050" + "00000007" + "00000009" + "5012200000000000")
UDP = bytes.fromhex("0035d431" + "0009" + "0000" + "61")
FRAMES = {
    "v4": MACS + b"\x08\x00" + V4 + TCP + bytes(6),
    "v6": MACS + b"\x86\xdd" + V6 + TCP + b"GET ",
    "tags": MACS + bytes.fromhex("88a8" + "2005" + "8100" + "6064" + "0800") + V4 + TCP,
    "udp6": MACS + b"\x86\xdd" + V6[:4] + b"\x00\x09\x11" + V6[7:] + UDP,
    "arp": MACS + b"\x08\x06" + bytes(28),
}


def frames(spark):
    return spark.createDataFrame([(n, k + 1, 10**15 + k, f) for k, (n, f) in enumerate(FRAMES.items())], "path string, frame_no long, ts_us long, frame binary")


def test_addresses_are_those_of_the_system(spark):
    rng = random.Random(1)
    some = [bytes(16), bytes(15) + b"\1", bytes(10) + b"\xff\xff\1\2\3\4", bytes.fromhex("20010000000100000000000100000000")]
    some += [b"".join(rng.choice([b"\0\0", b"\0\1", b"\x10\0"]) for _ in range(8)) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in some], "b binary").select("b", pcap._ip6(F.col("b")).alias("t")).collect()
    assert all(r.t == socket.inet_ntop(socket.AF_INET6, bytes(r.b)) for r in got)


def test_every_kind_of_frame(spark):
    d = dict(zip(FRAMES, pcap.decoded(frames(spark)).orderBy("frame_no").collect(), strict=True))
    assert (d["v4"].ip_src, d["v4"].sport, bytes(d["v4"].payload), d["v4"].ip_flags_df, d["v4"].tcp_seq, d["v4"].tcp_ack) == ("10.0.0.1", 40000, b"", 1, 7, 9)
    v6 = d["v6"]
    assert (v6.ip_version, v6.ip_src, v6.ip_dst, v6.l4_proto, v6.sport, v6.dport, v6.ttl_hlim, v6.dscp, v6.ecn) == (6, "2001:db8::1", "fe80::2", 6, 40000, 80, 55, 46, 0)
    assert (v6.ip_tos, v6.ip_proto, v6.ip_flags_df, v6.ipv4_checksum_ok, bytes(v6.payload)) == (None, None, None, None, b"GET ")
    tags = d["tags"]
    assert (tags.eth_type, tags.vlan_id, tags.vlan_prio, [tuple(t) for t in tags.vlan_stack], tags.ip_dst) == ("0x88a8", 5, 1, [(5, 1), (100, 3)], "10.0.1.2")
    assert (d["udp6"].l4_proto, d["udp6"].sport, d["udp6"].udp_len, d["udp6"].tcp_flags) == (17, 53, 9, "")
    assert (d["arp"].ip_src, d["arp"].l4_proto, d["arp"].l4_checksum_ok, d["arp"].vlan_id) == (None, None, None, None)


def test_lines_of_decoded_frames(spark):
    got = dict(zip(FRAMES, (r.line.split("\n") for r in dashboard.frame_lines(with_times(pcap.decoded(frames(spark)))).orderBy("frame_no").collect()), strict=True))
    assert "L3: IPv4 10.0.0.1->10.0.1.2 proto=6 ttl=64 id=1 flags=DF DSCP=0 ECN=0 frag_off=0" in got["v4"]
    assert "L4: TCP 40000->80 seq=7 ack=9 flags=SA win=8192" in got["v6"]
    assert "L3: IPv6 2001:db8::1->fe80::2 nh=6 hlim=55 tc=184" in got["v6"]
    assert [x for x in got["tags"] if "VLAN" in x] == ["  VLAN id=5 pri=1", "  VLAN id=100 pri=3"]
    assert "L4: UDP 53->54321 len=9" in got["udp6"] and not any(x.startswith(("L3", "L4", "  L4")) for x in got["arp"])


def test_frames_of_several_captures_are_numbered_on(spark, tmp_path):
    some = spark.createDataFrame([(k, 10**15 + k, FRAMES["v4"] if k % 2 else FRAMES["v6"], k // 5) for k in range(1, 10)], "frame_no long, ts_us long, frame binary, part int")
    for r in pcap.pcap_bytes(some).collect():
        (tmp_path / f"{r.part}.pcap").write_bytes(bytes(r.content))
    packets = Engine.from_capture(spark, str(tmp_path), filtered=False).packets
    rows = packets.orderBy("frame_no").collect()
    assert [(r.frame_no, r.ts_us) for r in rows] == [(k, 10**15 + k) for k in range(1, 10)]
    assert features(packets).count() == 9


def test_bytes_that_are_no_text(spark):
    for data, want in {
        "GET /ü HTTP/1.1\r\nHost: ü.example\r\n\r\n".encode(): ("GET", "ü.example", "/ü"),
        b"GET /a\xff HTTP/1.1\r\nHost:\t h\xfe.x \r\n\r\n": ("GET", "h.x", "/a"),
        b"HTTP/1.1 200 \xc3OK\r\n\r\n": ("RESP", None, "HTTP/1.1 200 OK"),
        b"GE\xffT /a HTTP/1.1\r\n\r\n": (None, None, None),
    }.items():
        assert payload.http_head(data) == want
        assert tuple(spark.range(1).select(payload.http_parse(F.lit(data)).alias("h")).first().h) == want


def _hello(ext: bytes) -> bytes:
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack(">HHH", len(ext) + 4, 0, len(ext)) + ext
    hello = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(hello)) + hello


def test_server_name_list_is_bounded():
    assert payload.server_name(_hello(struct.pack(">HBH", 5, 0, 2) + b"ab")) == "ab"
    assert payload.server_name(_hello(struct.pack(">HBH", 4, 0, 2) + b"ab")) is None  # the list ends within the name
    assert payload.server_name(_hello(b"\x00\x00\x00\x00")) is None


def test_both_time_stamps_of_tcp_options(spark):
    options = bytes.fromhex("0101080a" + "00000011" + "00000022")
    assert spark.range(1).select(payload.tcp_options(F.lit(options)).alias("o")).first().o == {"Timestamp": 17, "TimestampEcho": 34}
