"""Dashboard queries over scores and flows: counts, histograms, tops, pages, evidence, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.text import existing, number, plain
from flowlens.operators.flowkey import KEY
from flowlens.schema import EVIDENCE_COLS, EVIDENCE_EXPORT_COLS, TOP_FLOW_COLS, TOP_PACKET_COLS

PROTOCOLS = ("http", "tls", "ssh", "smb")
PAGE, EVIDENCE_PAGE, TOP = 50, 9, 10


def summary(features: DataFrame, scores: DataFrame, flows: DataFrame) -> DataFrame:
    """name, n: rows of each table."""
    parts = [df.select(F.lit(n).alias("name")).groupBy("name").agg(F.count("*").alias("n")) for n, df in (("features", features), ("scores", scores), ("flows", flows))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def histogram(df: DataFrame, column: str) -> DataFrame:
    """value, n, most frequent first; NULL is `unknown`."""
    return df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def average_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg(number(F.col("ip_fraud_score"))), 2).alias("avg_score"))


def top_packets(scores: DataFrame, n: int = TOP) -> DataFrame:
    return existing(scores.orderBy(number(F.col("ip_fraud_score"), -1).desc(), "frame_no").limit(n), TOP_PACKET_COLS)


def top_flows(flows: DataFrame, n: int = TOP) -> DataFrame:
    return existing(flows.orderBy(number(F.col("flow_risk_score"), -1).desc(), *KEY).limit(n), TOP_FLOW_COLS)


def page(df: DataFrame, number_: int, size: int = PAGE, order: tuple = ("frame_no",)) -> DataFrame:
    """Page from 1; pages below are the first."""
    return df.orderBy(*order).offset((max(1, number_) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = PAGE) -> DataFrame:
    return df.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))


def evidence(flows: DataFrame, protocol: str | None = None, source: str | None = None) -> DataFrame:
    """Flows with protocol evidence; unknown protocols and sources do not filter."""
    c = lambda n: plain(F.col(f"flow_{n}"))
    some = lambda n: number(F.col(f"flow_{n}"), 0) > 0
    hint = c("protocol_hint")
    base = (c("http_method") != "") | (c("http_host") != "") | (c("tls_sni") != "") | some("ssh_payload_detected") | some("smb_payload_detected") | hint.isin(*PROTOCOLS)
    df = flows.where(base)
    by_protocol = {
        "http": (hint == "http") | (c("http_method") != "") | (c("http_host") != ""),
        "tls": (hint == "tls") | (c("tls_sni") != "") | (c("tls_detect_source") != ""),
        "ssh": (hint == "ssh") | some("ssh_seen") | some("ssh_payload_detected"),
        "smb": (hint == "smb") | some("smb_seen") | some("smb_payload_detected"),
    }
    if protocol in by_protocol:
        df = df.where(by_protocol[protocol])
    if source in ("payload", "port"):
        any_of = F.lit(False)
        for p in PROTOCOLS:
            any_of = any_of | (c(f"{p}_detect_source") == source)
        df = df.where(any_of)
    return existing(df, EVIDENCE_COLS)


def evidence_page(flows: DataFrame, number_: int = 1, ascending: bool = False, **filters) -> DataFrame:
    score = number(F.col("flow_risk_score"), -1)
    return page(evidence(flows, **filters), number_, EVIDENCE_PAGE, (score.asc() if ascending else score.desc(), *KEY_OF_EVIDENCE))


KEY_OF_EVIDENCE = [k for k in KEY if k in EVIDENCE_COLS]


def export_evidence(flows: DataFrame, protocol: str | None = None, source: str | None = None) -> DataFrame:
    """Every flow with a hint; a source is compared with that of the hint's own protocol."""
    hint = plain(F.col("flow_protocol_hint"))
    df = flows.where(hint != "")
    if protocol in PROTOCOLS:
        df = df.where(hint == protocol)
    if source in ("payload", "port"):
        own = F.lit("")
        for p in PROTOCOLS:
            own = F.when(hint == p, plain(F.col(f"flow_{p}_detect_source"))).otherwise(own)
        df = df.where(own == source)
    return existing(df, EVIDENCE_EXPORT_COLS)


def summary_text(flows: DataFrame) -> DataFrame:
    """Key, source and one sentence per flow with evidence."""
    c = lambda n: F.coalesce(F.col(f"flow_{n}"), F.lit(""))
    hint = F.lower(F.coalesce(F.nullif(F.col("flow_protocol_hint"), F.lit("")), F.lit("unknown")))
    told = lambda lead, x: F.when(x != "", F.concat(F.lit(lead), x)).otherwise("")
    text = (
        F.when(hint == "http", F.concat(F.lit("Client requested "), F.coalesce(F.nullif(c("http_method"), F.lit("")), F.lit("HTTP")), F.lit(" "), c("http_host"), c("http_path")))
        .when(hint == "tls", F.concat(F.lit("Observed encrypted web session"), told(" to ", c("tls_sni"))))
        .when(hint == "ssh", F.concat(F.lit("Observed SSH session"), told(" with banner ", c("ssh_banner"))))
        .when(hint == "smb", F.concat(F.lit("Observed "), F.coalesce(F.nullif(c("smb_version"), F.lit("")), F.lit("SMB")), F.lit(" file-sharing traffic")))
        .otherwise("Protocol evidence observed.")
    )
    source = F.coalesce(*[F.nullif(c(f"{p}_detect_source"), F.lit("")) for p in PROTOCOLS], F.lit("unknown"))
    return flows.select(*KEY, source.alias("detect_source"), F.trim(text).alias("summary"))


def export_name(ts, base: str, ext: str):
    """YYYYMMDD_HHMM_base.ext of a timestamp column."""
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmm"), F.lit(f"_{base}.{ext}"))


def _six(x):
    """A number with six decimals: of its twelve in double arithmetic, halves rounded up."""
    twelve = F.rint(x * 1e12)
    exact = twelve.cast("long").cast("decimal(19,0)") / F.lit(10**12).cast("decimal(13,0)")
    kept = F.when(F.abs(twelve) < 9e18, exact.cast("decimal(30,12)")).otherwise(x.cast("decimal(30,12)"))
    return F.round(kept, 6).cast("decimal(30,6)").cast("string")


def flow_lines(flows: DataFrame) -> DataFrame:
    """The capture log's line for each flow."""
    seconds = [_six(F.col(f"flow_{n}")) for n in ("duration", "iat_min", "iat_avg", "iat_max")]
    line = F.format_string(
        "%s:%d -> %s:%d proto=%d pkts=%d bytes=%d dur=%ss iat_min=%ss iat_avg=%ss iat_max=%ss",
        "flow_src_ip", "flow_src_port", "flow_dst_ip", "flow_dst_port", "flow_proto", "flow_pkts", "flow_bytes", *seconds,
    )
    return flows.select("first_frame_no", line.alias("line"))


def frame_lines(packets: DataFrame, preview: int | None = 32) -> DataFrame:
    """The capture log's lines of each packet, with a preview of its first bytes or, where preview is None, all of them.

    Bytes are those of the frame, of the payload if packets have no frame.

    The line of times is written if packets have them (features.with_times); flags of the IP header, TCP
    sequence numbers, UDP lengths, all VLAN tags and IPv6 as such if packets have what decoded captures have.
    """
    from flowlens.functions.header import hex_preview
    from flowlens.functions.payload import http_parse, tls_sni

    s = lambda n: F.col(n).cast("string")
    ok = lambda n: F.when(F.col(n).isNull(), "NA").when(F.col(n) == 1, "OK").otherwise("BAD")
    times = [F.concat(F.lit("ts_epoch="), _six(F.col("ts_epoch")), F.lit(" ts_local="), F.ltrim("ts_local"), F.lit(" t_rel="), _six(F.col("t_rel")), F.lit("s"))] if "ts_local" in packets.columns else []
    tcp, http = F.col("l4_proto") == 6, http_parse(F.col("payload"))
    none = lambda x: F.coalesce(x, F.lit("None"))
    whole = "tcp_seq" in packets.columns
    told = lambda lead, x: F.concat(F.lit(lead), x) if whole else F.lit("")
    vlan = F.concat(F.lit("  VLAN id="), s("vlan_id"), F.lit(" pri="), s("vlan_prio"))
    if whole:
        vlan = F.nullif(F.array_join(F.transform("vlan_stack", lambda t: F.concat(F.lit("  VLAN id="), t["id"].cast("string"), F.lit(" pri="), t["prio"].cast("string"))), "\n"), F.lit(""))
    bits = F.concat_ws("+", F.when(F.col("ip_flags_mf") == 1, "MF"), F.when(F.col("ip_flags_df") == 1, "DF"))
    v4 = F.concat(F.lit("L3: IPv"), s("ip_version"), F.lit(" "), F.col("ip_src"), F.lit("->"), F.col("ip_dst"), F.lit(" proto="), s("ip_proto"), F.lit(" ttl="), s("ttl_hlim"),
                  F.lit(" id="), s("ip_id"), told(" flags=", bits), F.lit(" DSCP="), s("dscp"), F.lit(" ECN="), s("ecn"), F.lit(" frag_off="), s("ip_frag_off"))
    v6 = F.concat(F.lit("L3: IPv6 "), F.col("ip_src"), F.lit("->"), F.col("ip_dst"), F.lit(" nh="), none(s("l4_proto")), F.lit(" hlim="), s("ttl_hlim"), F.lit(" tc="), (F.col("dscp") * 4 + F.col("ecn")).cast("string"))
    data = F.col("frame" if "frame" in packets.columns else "payload")
    if preview is None:
        shown = F.concat(F.lit("FrameBytes("), F.length(data).cast("string"), F.lit("B): "), hex_preview(data))
    else:
        shown = F.concat(F.lit("PayloadPreview("), F.least(F.lit(preview), F.length(data)).cast("string"), F.lit("B): "), hex_preview(data, preview))
    lines = [
        F.concat(F.lit("=== Frame "), s("frame_no"), F.lit(" ===")),
        *times,
        F.concat(F.lit("L2: Ethernet src="), F.col("eth_src"), F.lit(" dst="), F.col("eth_dst"), F.lit(" type="), F.col("eth_type")),
        vlan,
        F.when(F.col("ip_version") == 6, v6).otherwise(v4),
        F.when(F.col("ip_version") == 4, F.concat(F.lit("  IPv4_checksum="), ok("ipv4_checksum_ok"))),
        F.when(tcp, F.concat(F.lit("L4: TCP "), s("sport"), F.lit("->"), s("dport"), told(" seq=", s("tcp_seq")), told(" ack=", s("tcp_ack")), F.lit(" flags="), F.col("tcp_flags"), F.lit(" win="), s("tcp_win")))
        .when(F.col("l4_proto") == 17, F.concat(F.lit("L4: UDP "), s("sport"), F.lit("->"), s("dport"), told(" len=", s("udp_len")))),
        F.when(F.col("l4_proto").isin(6, 17), F.concat(F.lit("  L4_checksum="), ok("l4_checksum_ok"))),
        F.when(tcp, F.concat(F.lit("TLS SNI="), F.nullif(tls_sni(F.col("payload")), F.lit("")))),
        F.when(tcp, F.concat(F.lit("HTTP "), http["method"], F.lit(" host="), none(http["host"]), F.lit(" path="), none(http["path"]))),
        shown,
    ]
    return packets.select("frame_no", F.concat_ws("\n", *lines).alias("line"))
