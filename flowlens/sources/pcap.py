"""Capture files: frames out of pcap files, pcap files out of frames, and decoding of frames."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions import header as h

FRAMES = "path string, frame_no long, ts_us long, frame binary"


def _frames(data: bytes):
    """(number from 1, microseconds, frame) of a pcap file's bytes, either byte order, micro- or nanoseconds.
    A record cut off at the end is left out."""
    magic = data[:4]
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    if magic not in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\xa1\xb2\x3c\x4d"):
        return
    nano = magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d")
    at, n = 24, 0
    while at + 16 <= len(data):
        sec, frac, size, _ = struct.unpack(order + "IIII", data[at : at + 16])
        if at + 16 + size > len(data):
            return
        n += 1
        yield n, sec * 1_000_000 + (frac // 1000 if nano else frac), data[at + 16 : at + 16 + size]
        at += 16 + size


def _parse(batches):
    for batch in batches:
        rows = [(p, n, ts, f) for p, data in zip(batch["path"], batch["content"], strict=True) for n, ts, f in _frames(data)]
        yield pd.DataFrame(rows, columns=["path", "frame_no", "ts_us", "frame"])


def read_pcap(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """path, frame_no (from 1 within its file), ts_us, frame of pcap files, in any store that Spark reads."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return reader.format("binaryFile").load(path).select("path", "content").mapInPandas(_parse, FRAMES)


def pcap_bytes(frames: DataFrame, group: str = "part") -> DataFrame:
    """One pcap file per group of (frame_no, ts_us, frame): group, content."""

    def write(key, pdf):
        out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)]
        for r in pdf.sort_values("frame_no").itertuples(index=False):
            out.append(struct.pack("<IIII", r.ts_us // 1_000_000, r.ts_us % 1_000_000, len(r.frame), len(r.frame)) + r.frame)
        return pd.DataFrame({group: [key[0]], "content": [b"".join(out)]})

    return frames.groupBy(group).applyInPandas(write, f"{group} {dict(frames.dtypes)[group]}, content binary")


def encoded(packets: DataFrame) -> DataFrame:
    """frame_no, ts_us, wire_bytes and frame: Ethernet frames of IPv4 packets with TCP or UDP, as decoded() reads them.

    Checksums are right where their column is 1 and wrong otherwise; lengths are
    those of the frame, len_bytes is on the wire.  Missing numbers are 0.
    """
    digits = lambda x, n: F.lpad(F.hex(F.coalesce(x, F.lit(0)).cast("long")), n, "0")
    c, tcp = F.col, F.col("l4_proto") == 6
    stored = lambda data, ok: h.bound(h.ones_complement(data), lambda x: F.when(ok == 1, x).otherwise((x + 1) % 65536))
    flags = sum((F.when(F.contains("tcp_flags", F.lit(x)), b).otherwise(0) for x, b in (("S", 2), ("R", 4), ("P", 8), ("A", 16), ("U", 32))), F.when(F.contains("tcp_flags", F.lit("F")), 1).otherwise(0))
    data, size = F.coalesce("payload", F.lit(b"")), F.length(F.coalesce("payload", F.lit(b"")))
    f = packets.withColumns({"_src": h.ip_bytes(c("ip_src")), "_dst": h.ip_bytes(c("ip_dst")), "_size": size + F.when(tcp, 20).otherwise(8)})
    ports = F.concat(digits(c("sport"), 4), digits(c("dport"), 4))
    l4 = lambda sums: F.concat(F.unhex(F.when(tcp, F.concat(ports, digits(c("tcp_seq"), 8), digits(c("tcp_ack"), 8), F.lit("50"), digits(flags, 2), digits(c("tcp_win"), 4), sums, F.lit("0000"))).otherwise(F.concat(ports, digits(c("_size"), 4), sums))), data)
    ip = lambda sums: F.unhex(F.concat(digits(c("ip_tos") + 0x4500, 4), digits(c("_size") + 20, 4), digits(c("ip_id"), 4), digits(c("ip_flags_df") * 0x4000 + c("ip_flags_mf") * 0x2000 + c("ip_frag_off"), 4), digits(c("ttl_hlim") * 256 + c("l4_proto"), 4), sums, F.hex("_src"), F.hex("_dst")))
    more = {x: F.lit(0) for x in ("tcp_seq", "tcp_ack") if x not in packets.columns}
    pseudo = F.concat(c("_src"), c("_dst"), F.unhex(F.concat(digits(c("l4_proto"), 4), digits(c("_size"), 4))))
    f = f.withColumns(more).withColumns({"_ip": stored(ip(F.lit("0000")), c("ipv4_checksum_ok")), "_sum": stored(F.concat(pseudo, l4(F.lit("0000"))), c("l4_checksum_ok"))})
    mac = lambda x: F.unhex(F.replace(x, F.lit(":"), F.lit("")))
    tag = F.when(c("vlan_id").isNotNull(), F.unhex(F.concat(F.lit("8100"), digits(c("vlan_prio") * 8192 + c("vlan_id"), 4)))).otherwise(F.lit(b""))
    frame = F.concat(mac(c("eth_dst")), mac(c("eth_src")), tag, F.lit(b"\x08\x00"), ip(digits(c("_ip"), 4)), l4(digits(c("_sum"), 4)))
    return f.select("frame_no", "ts_us", c("len_bytes").alias("wire_bytes"), frame.alias("frame"))


def _mac(data: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(data)), "(..)(?=.)", "$1:")


def _ip4(data: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(data, k, 1)), 16, 10) for k in range(1, 5)])


def _ip6(data: Column) -> Column:
    """16 bytes in the usual short form: the first of the longest runs of zero groups is left out."""

    def short(digits: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda k: F.regexp_replace(F.substring(digits, k, F.lit(4)), "^0{1,3}", ""))
        return h.bound(F.array_join(groups, ":"), shortest)

    def shortest(text: Column) -> Column:
        out = text
        for run in range(2, 9):  # the longest that there is decides
            zeros = f"(?:^|:)0(?::0){{{run - 1}}}(?:$|:)"
            out = F.when(F.rlike(text, F.lit(zeros)), F.regexp_replace(text, f"^(.*?){zeros}(.*)$", "$1::$2")).otherwise(out)
        return out

    mapped = F.substring(data, 1, 12) == F.lit(bytes(10) + b"\xff\xff")
    return F.when(mapped, F.concat(F.lit("::ffff:"), _ip4(F.substring(data, 13, 4)))).otherwise(h.bound(F.lower(F.hex(data)), short))


def numbered(frames: DataFrame, span: int = 1 << 28) -> DataFrame:
    """Frames of several captures with frame_no running on from one to the next, in order of path.

    Where frames have their place in the file, `at`, they are counted by spans of
    so many bytes, a row each, and numbered inside a span; else frame_no is their
    number in the file.
    """
    if "at" not in frames.columns:
        sizes = frames.groupBy("path").agg(F.max("frame_no").alias("_n"))
        before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
        starts = sizes.select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        return frames.join(starts, "path").withColumn("frame_no", F.col("frame_no") + F.col("_before")).drop("_before")
    spans = frames.withColumn("_span", F.floor(F.col("at") / span))
    before = Window.orderBy("path", "_span").rowsBetween(Window.unboundedPreceding, -1)  # a row per span
    starts = spans.groupBy("path", "_span").agg(F.count(F.lit(1)).alias("_n")).select("path", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("path", "_span").orderBy("at"))
    return spans.withColumn("frame_no", own.cast("long")).join(starts, ["path", "_span"]).withColumn("frame_no", F.col("frame_no") + F.col("_before")).drop("_span", "_before")


def decoded(frames: DataFrame) -> DataFrame:
    """Packet columns of Ethernet frames with any VLAN tags and IPv4 or IPv6; other fields are NULL.

    vlan_id and vlan_prio are the outermost tag's, vlan_stack has all.  IPv6 extension headers are not
    walked: such packets have no ports.  A payload ends where the IP packet does, padding is left out.
    """
    tag = F.col("frame")
    tagged = h.be16(tag, 12).isin(0x8100, 0x88A8)
    tags = F.when(tagged, F.length(F.regexp_extract(F.hex(F.substring(tag, F.lit(13), F.length(tag))), "^(?:(?:8100|88A8)[0-9A-F]{4})+", 0)) / 8).otherwise(0)
    f = frames.withColumn("_tags", tags.cast("int")).withColumn("_at", F.col("_tags") * 4 + 14)
    f = f.withColumn("_type", h.be16(F.col("frame"), F.col("_at") - 2))
    f = f.withColumn("_ip", F.when(F.col("_type").isin(0x0800, 0x86DD), F.expr("substring(frame, _at + 1, length(frame))")))
    v4, v6 = F.col("_type") == 0x0800, F.col("_type") == 0x86DD
    f = f.withColumns({"_head": F.when(v4, h.ihl_bytes(h.byte_at(F.col("_ip"), 0))).when(v6, 40), "_proto": F.when(v4, h.byte_at(F.col("_ip"), 9)).when(v6, h.byte_at(F.col("_ip"), 6))})
    f = f.withColumn("_l4", F.expr("substring(_ip, _head + 1, length(_ip))"))
    tcp, udp, l4 = F.col("_proto") == 6, F.col("_proto") == 17, F.col("_proto").isin(6, 17)
    offset = h.tcp_header_bytes(h.byte_at(F.col("_l4"), 12))
    stated = F.when(v4, h.be16(F.col("_ip"), 2) - F.col("_head")).otherwise(F.nullif(h.be16(F.col("_ip"), 4), F.lit(0)))
    size = F.when(stated >= 0, F.least(stated, F.length("_l4"))).otherwise(F.length("_l4"))
    tos, word = F.when(v4, h.byte_at(F.col("_ip"), 1)), F.when(v4, h.be16(F.col("_ip"), 6))
    traffic = F.when(v4, tos).otherwise(F.shiftright(h.be16(F.col("_ip"), 0), 4).bitwiseAND(255))
    only4 = lambda x: F.when(v4, x)
    address = lambda at4, at6: F.when(v4, _ip4(F.substring("_ip", at4, 4))).when(v6, _ip6(F.substring("_ip", at6, 16)))
    raw = lambda at4, at6: F.when(v4, F.substring("_ip", at4, 4)).otherwise(F.substring("_ip", at6, 16))
    long_at = lambda at: F.conv(F.hex(F.substring("_l4", at + 1, 4)), 16, 10).cast("long")
    bits = h.byte_at(F.col("_l4"), 13)
    letters = F.concat(*[F.when(bits.bitwiseAND(b) != 0, x).otherwise("") for x, b in (("F", 1), ("S", 2), ("R", 4), ("P", 8), ("A", 16), ("U", 32))])
    control = lambda at: h.be16(F.col("frame"), at)
    stack = F.transform(
        F.when(F.col("_tags") > 0, F.sequence(F.lit(0), F.col("_tags") - 1)),
        lambda k: F.struct(control(k * 4 + 14).bitwiseAND(0xFFF).alias("id"), F.shiftright(control(k * 4 + 14), 13).alias("prio")),
    )
    return f.select(
        "frame_no", "ts_us", F.length("frame").cast("long").alias("len_bytes"),
        _mac(F.substring("frame", 7, 6)).alias("eth_src"), _mac(F.substring("frame", 1, 6)).alias("eth_dst"),
        h.ethertype_hex(control(12)).alias("eth_type"),
        F.when(tagged, control(14).bitwiseAND(0xFFF)).alias("vlan_id"), F.when(tagged, F.shiftright(control(14), 13)).alias("vlan_prio"), stack.alias("vlan_stack"),
        F.shiftright(h.byte_at(F.col("_ip"), 0), 4).alias("ip_version"), tos.alias("ip_tos"), h.dscp(traffic).alias("dscp"), h.ecn(traffic).alias("ecn"),
        only4(h.be16(F.col("_ip"), 2)).alias("ip_total_len"), only4(h.be16(F.col("_ip"), 4)).alias("ip_id"), *[v.alias(n) for n, v in h.fragment_fields(word).items()],
        F.when(v4, h.byte_at(F.col("_ip"), 8)).otherwise(h.byte_at(F.col("_ip"), 7)).alias("ttl_hlim"), only4(F.col("_proto")).alias("ip_proto"),
        only4(h.be16(F.col("_ip"), 10)).alias("ip_hdr_checksum"), only4(h.ipv4_checksum_ok(F.expr("substring(_ip, 1, _head)"))).alias("ipv4_checksum_ok"),
        address(13, 9).alias("ip_src"), address(17, 25).alias("ip_dst"), only4(F.col("_head")).alias("ip_ihl_bytes"),
        F.when(l4, F.col("_proto")).alias("l4_proto"), F.when(l4, h.be16(F.col("_l4"), 0)).alias("sport"), F.when(l4, h.be16(F.col("_l4"), 2)).alias("dport"),
        F.when(tcp, letters).otherwise("").alias("tcp_flags"), F.when(tcp, h.be16(F.col("_l4"), 14)).alias("tcp_win"), F.when(tcp, offset).alias("tcp_hdr_len"),
        F.when(tcp, long_at(4)).alias("tcp_seq"), F.when(tcp, long_at(8)).alias("tcp_ack"), F.when(udp, h.be16(F.col("_l4"), 4)).alias("udp_len"),
        h.l4_checksum_ok(F.when(v4, 4).when(v6, 6), F.col("_proto"), raw(13, 9), raw(17, 25), F.col("_l4")).alias("l4_checksum_ok"),
        F.when(tcp, F.substring(F.col("_l4"), offset + 1, F.greatest(size - offset, F.lit(0)))).otherwise(F.lit(b"")).alias("payload"),
        "frame",
    )
