"""Packet, flow, score and dashboard queries, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import header, payload, text
from flowlens.functions.capture_filter import default_filter
from flowlens.ml.models import matrix
from flowlens.operators import dashboard, scores as scoring
from flowlens.operators.features import features, with_address_counts, with_times
from flowlens.operators.flowkey import KEY, with_flow_key
from flowlens.operators.flows import flows, running, times_between
from flowlens.operators.rules import coerced, with_heuristics
from flowlens.plans.oracle import sql
from flowlens.plans.packets import packets
from flowlens.sources import capture, log, pcap
from flowlens.sources.shared import partitions, shared_path
from flowlens.schema import (
    EVIDENCE_COLS, EVIDENCE_EXPORT_COLS, FEATURE_COLS, FLAG_LETTERS, FLOW_COLS, SCORE_COLS, SSH_SMB, TOP_FLOW_COLS, TOP_PACKET_COLS, TRAIN_FEATURES,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None, *sources: str) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE_SQL[name] = sql(oracle, *sources) if sources else oracle


def on_packets(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(packets(spark, d))


def on_flows(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(flows(packets(spark, d)))


def on_features(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(features(packets(spark, d)))


def on_scores(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(scoring.scores(features(packets(spark, d))))


c, lit = F.col, F.lit
names = ", ".join

# -- scans and tables
RAW = [x for x in FEATURE_COLS if not x.startswith(("flow_", "src_", "t_rel", "ts_"))]
add("scan_features", on_packets(lambda p: p.select(*RAW)), f"select {names(RAW)} from pkt", "pkt")
add(
    "bpf_default_filter",
    on_packets(lambda p: p.where(default_filter()).select("frame_no", "sport", "dport")),
    "select frame_no, sport, dport from pkt where ip_version=4 and l4_proto=6 and (sport in (22,80,443,445) or dport in (22,80,443,445))", "pkt",
)
add("features_table", on_features(lambda f: f), f"select {names(FEATURE_COLS)} from features", "features")
add("flows_table", on_flows(lambda f: f.select(*FLOW_COLS)), f"select {names(FLOW_COLS)} from flow", "flow")
add("scores_table", on_scores(lambda s: s), "select * from scores", "scores")
add("scores_all", on_scores(lambda s: s.select("frame_no", *SCORE_COLS)), f"select frame_no, {names(SCORE_COLS)} from scores", "scores")
add("frame_no", on_packets(lambda p: p.agg(F.min("frame_no").alias("lo"), F.max("frame_no").alias("hi"), F.count_distinct("frame_no").alias("n"))), "select min(frame_no) as lo, max(frame_no) as hi, count(distinct frame_no) as n from pkt", "pkt")

# -- header functions
def word():
    return c("k") * 7919 % 65536


def tos():
    return c("k") % 256


FIELDS = "(k*7919)%65536"
add("be16", on_packets(lambda p: p.select("frame_no", header.be16(F.unhex(F.lpad(F.hex(word()), 8, "0")), 2).alias("value"))), f"select frame_no, {FIELDS} as value from pkt", "pkt")


def _header_bytes() -> F.Column:
    """A 20-byte IPv4 header of the packet's columns, its checksum field 0."""
    part = lambda x, n: F.lpad(F.hex(x.cast("long")), n, "0")
    words = [part(c("ip_tos") + 0x4500, 4), part(c("ip_total_len"), 4), part(c("ip_id"), 4), part(c("ip_flags_mf") * 0x2000 + c("ip_frag_off"), 4), part(c("ttl_hlim") * 256 + c("l4_proto"), 4), lit("0000")]
    return F.concat(F.unhex(F.concat(*words)), header.ip_bytes(c("ip_src")), header.ip_bytes(c("ip_dst")))


_IP16 = " + ".join(f"cast(split_part({ip},'.',{k}) as bigint)*256 + cast(split_part({ip},'.',{k + 1}) as bigint)" for ip in ("ip_src", "ip_dst") for k in (1, 3))
_SUM = f"17664 + ip_tos + ip_total_len + ip_id + ip_flags_mf*8192 + ip_frag_off + ttl_hlim*256 + l4_proto + {_IP16}"
_CHECK = f"65535 - (({_SUM} - 1) % 65535 + 1)"
add("ones_complement", on_packets(lambda p: p.select("frame_no", header.ones_complement(_header_bytes()).alias("checksum"))), f"select frame_no, {_CHECK} as checksum from pkt", "pkt")


def _ipv4_checksum(p: DataFrame) -> DataFrame:
    stored = lambda bare: F.when(c("k") % 31 == 0, lit(0)).otherwise(header.ones_complement(bare))
    whole = header.bound(_header_bytes(), lambda bare: F.concat(F.substring(bare, 1, 10), F.unhex(F.lpad(F.hex(stored(bare)), 4, "0")), F.substring(bare, 13, 8)))
    return p.select("frame_no", header.ipv4_checksum_ok(whole).alias("ok"))


add("ipv4_checksum", on_packets(_ipv4_checksum), f"select frame_no, case when k%31=0 and {_CHECK}<>0 then 0 else 1 end as ok from pkt", "pkt")


def _l4_checksum(p: DataFrame) -> DataFrame:
    """Segments of the packet's ports with a right checksum, but for every 11th."""
    ports = F.unhex(F.concat(F.lpad(F.hex("sport"), 4, "0"), F.lpad(F.hex("dport"), 4, "0")))
    tcp = c("l4_proto") == 6
    head = F.when(tcp, F.concat(ports, lit(bytes(8) + b"\x50\x00\x20\x00"))).otherwise(F.concat(ports, lit(b"\x00\x09")))
    tail = F.when(tcp, lit(b"\x00\x00\x07")).otherwise(lit(b"\x07"))
    src, dst = header.ip_bytes(c("ip_src")), header.ip_bytes(c("ip_dst"))
    size = F.length(head) + 2 + F.length(tail)
    pseudo = F.concat(src, dst, lit(b"\x00"), F.unhex(F.lpad(F.hex(c("l4_proto")), 2, "0")), F.unhex(F.lpad(F.hex(size.cast("long")), 4, "0")))
    right = header.ones_complement(F.concat(pseudo, head, lit(b"\x00\x00"), tail))
    stored = header.bound(right, lambda r: F.when(c("k") % 11 == 0, (r + 1) % 65536).otherwise(r))
    segment = F.concat(head, F.unhex(F.lpad(F.hex(stored), 4, "0")), tail)
    return p.select("frame_no", header.l4_checksum_ok(c("ip_version"), c("l4_proto"), src, dst, segment).alias("ok"))


add("l4_checksum", on_packets(_l4_checksum), "select frame_no, case when k%11=0 then 0 else 1 end as ok from pkt", "pkt")
add("tcp_options", on_packets(lambda p: p.select("frame_no", F.unhex(F.concat(lit("02040"), F.lpad(F.hex(c("k") % 4096), 3, "0"), lit("0103030700"))).alias("o")).withColumn("o", payload.tcp_options("o")).select("frame_no", c("o")["MSS"].alias("mss"), c("o")["WScale"].alias("wscale"))), "select frame_no, cast(k%4096 as bigint) as mss, cast(7 as bigint) as wscale from pkt", "pkt")
add("tos_split", on_packets(lambda p: p.select("frame_no", header.dscp(tos()).alias("dscp"), header.ecn(tos()).alias("ecn"))), "select frame_no, (k%256)//4 as dscp, k%4 as ecn from pkt", "pkt")
add("ip_fragment_fields", on_packets(lambda p: p.select("frame_no", *[v.alias(n) for n, v in header.fragment_fields(word()).items()])), f"select frame_no, ({FIELDS}//16384)%2 as ip_flags_df, ({FIELDS}//8192)%2 as ip_flags_mf, {FIELDS}%8192 as ip_frag_off from pkt", "pkt")
add("header_lengths", on_packets(lambda p: p.select("frame_no", header.ihl_bytes(tos()).alias("ip"), header.tcp_header_bytes(tos()).alias("tcp"))), "select frame_no, (k%16)*4 as ip, ((k%256)//16)*4 as tcp from pkt", "pkt")
add("ethertype_hex", on_packets(lambda p: p.select("frame_no", header.ethertype_hex(word()).alias("eth_type"))), f"select frame_no, '0x' || lpad(lower(hex({FIELDS})), 4, '0') as eth_type from pkt", "pkt")
add("vlan_fields", on_packets(lambda p: p.where("vlan_id is not null").select("frame_no", "vlan_id", "vlan_prio")), "select frame_no, vlan_id, vlan_prio from pkt where vlan_id is not null", "pkt")
FLAGS = {"SYN": "S", "ACK": "A", "FIN": "F", "RST": "R", "PSH": "P", "URG": "U"}
add("expand_tcp_flags", on_packets(lambda p: p.select("frame_no", *[v.alias(n) for n, v in header.flag_letters(c("tcp_flags")).items()])), "select frame_no, " + names(f"case when tcp_flags like '%{x}%' then 1 else 0 end as tcp_flag_{n}" for n, x in FLAGS.items()) + " from pkt", "pkt")
add("tcp_flag_bits", on_packets(lambda p: p.select("frame_no", *[v.alias(n) for n, v in header.flag_bits(F.when(c("k") % 7 != 0, c("k") % 64)).items()])), "select frame_no, " + names(f"case when k%7<>0 then ((k%64)//{b})%2 else 0 end as tcp_flag_{n}" for n, b in (("SYN", 2), ("ACK", 16), ("FIN", 1), ("RST", 4), ("PSH", 8), ("URG", 32))) + " from pkt", "pkt")
add("ts_local", on_packets(lambda p: with_times(p).select("frame_no", "ts_local")), "select frame_no, ts_local from timed", "timed")
add("t_rel", on_packets(lambda p: with_times(p).select("frame_no", "ts_epoch", "t_rel")), "select frame_no, ts_epoch, t_rel from timed", "timed")
add("hex_preview", on_packets(lambda p: p.where(F.length("payload") > 0).select("frame_no", header.hex_preview(c("payload"), 4).alias("preview"))), "select frame_no, case evidence when 'http' then '47 45 54 20' when 'reply' then '48 54 54 50' when 'ssh' then '53 53 48 2d' when 'smb2' then '00 00 00 2a' when 'smb1' then 'ff 53 4d 42' else '16 03 01 00' end as preview from pkt where evidence is not null", "pkt")

# -- payload functions
_HAS = lambda p: p.where(F.length("payload") > 0)
add("http_parse", on_packets(lambda p: _HAS(p).select("frame_no", payload.http_parse(c("payload")).alias("h")).where("h.method is not null").select("frame_no", "h.*")), "select frame_no, hm as method, case when evidence='http' then hh end as host, hp as path from keyed where hm is not null", "facts")
add("ssh_banner", on_packets(lambda p: _HAS(p).select("frame_no", payload.ssh_banner(c("payload")).alias("banner")).where("banner is not null")), "select frame_no, banner from keyed where banner is not null", "facts")
add("smb_signature", on_packets(lambda p: _HAS(p).select("frame_no", payload.smb_version(c("payload")).alias("version")).where("version is not null")), "select frame_no, smb as version from keyed where smb is not null", "facts")
add("tls_sni", on_packets(lambda p: p.where(c("evidence").isin("tls", "tls0")).select("frame_no", payload.tls_sni("payload").alias("sni"))), "select frame_no, sni from keyed where evidence in ('tls','tls0')", "facts")

# -- keys and text
add("packet_tuple", on_packets(lambda p: p.select("frame_no", "ip_src", "ip_dst", "l4_proto", "sport", "dport")), "select frame_no, ip_src, ip_dst, l4_proto, sport, dport from pkt", "pkt")
add("canonical_flow_key", on_packets(lambda p: with_flow_key(p).select("frame_no", *KEY)), f"select frame_no, {names(KEY)} from keyed", "facts")
add("packet_direction", on_packets(lambda p: with_flow_key(p).select("frame_no", F.when(c("fwd"), "fwd").otherwise("rev").alias("direction"))), "select frame_no, case when fwd=1 then 'fwd' else 'rev' end as direction from keyed", "facts")
_IP = lambda: F.concat_ws(".", *[(c("k") * m % n).cast("string") for m, n in ((3, 240), (7, 256), (11, 256), (13, 256))])
_IP6 = lambda: F.concat(F.lower(F.hex(c("frame_no") * 31 % 65536)), lit(":1::5"))
_IPS = "case when a in (0,10,127) or (a=169 and b=254) or (a=172 and b between 16 and 31) or (a=192 and b=168) or (a=192 and b=0 and cc=0 and not dd in (9,10)) or (a=192 and b=0 and cc=2) or (a=198 and b in (18,19)) or (a=198 and b=51 and cc=100) or (a=203 and b=0 and cc=113) or a>=224 then 0 else 1 end"
add("public_ip_filter", on_packets(lambda p: p.select("frame_no", header.public_ip(_IP()).cast("int").alias("public"), header.public_ip(_IP6()).cast("int").alias("public6"))),
    f"select frame_no, {_IPS} as public, case when g between 8192 and 16383 and g not in (8193, 8194) or g between 65216 and 65279 then 1 else 0 end as public6 from (select frame_no, frame_no*31%65536 as g, k*3%240 as a, k*7%256 as b, k*11%256 as cc, k*13%256 as dd from pkt) x", "pkt")
_LABEL = lambda: F.element_at(F.array(*map(lit, ["Normal", " malicious", "Tainted ", "good", "bad", "weird", "anomaly"])), c("k") % 7 + 1)
add("normalize_label", on_packets(lambda p: p.select("frame_no", text.label_name(_LABEL()).alias("by_name"), text.label_name(F.when(c("k") % 5 != 0, c("k") % 3), numeric=True).alias("by_number"))),
    "select frame_no, case k%7 when 0 then 'benign' when 1 then 'attack' when 2 then 'tampered' when 3 then 'benign' when 4 then 'attack' when 5 then 'weird' else 'attack' end as by_name, case when k%5=0 then 'nan' when k%3=1 then 'attack' else 'benign' end as by_number from pkt", "pkt")
add("label_from_score", on_packets(lambda p: p.select("frame_no", text.label_from_score(F.when(c("k") % 2 == 0, c("k") % 101), F.when(c("k") % 3 == 0, c("k") % 89)).alias("label"))),
    "select frame_no, case when s>=70 then 'attack' when s>=40 then 'tampered' when s is not null then 'benign' end as label from (select frame_no, coalesce(case when k%2=0 then k%101 end, case when k%3=0 then k%89 end) as s from pkt) x", "pkt")
add("confidence_policy", on_packets(lambda p: p.select("frame_no", text.confidence_label((c("k") % 101) / lit(100.0)).alias("label"))), "select frame_no, case when (k%101)/100.0>=0.90 then 'attack' when (k%101)/100.0>=0.80 then 'tampered' else 'benign' end as label from pkt", "pkt")
add("score_display", on_scores(lambda s: s.select("frame_no", "ip_fraud_score_display")), "select frame_no, ip_fraud_score_display from scores", "scores")
_TEXT = lambda: F.when(c("k") % 3 == 0, lit("x7")).when(c("k") % 3 == 1, F.concat(c("k").cast("string"), lit(".5")))
add("numeric_coerce", on_packets(lambda p: p.select("frame_no", text.number(_TEXT(), -1).alias("value"))), "select frame_no, case when k%3=1 then k+0.5 else -1.0 end as value from pkt", "pkt")
add("string_normalize", on_packets(lambda p: p.select("frame_no", text.plain(F.when(c("k") % 4 != 0, F.concat(lit(" \tHost"), c("k").cast("string"), lit("\n ")))).alias("value"))), "select frame_no, case when k%4<>0 then 'host' || cast(k as varchar) else '' end as value from pkt", "pkt")
add("project_existing", on_packets(lambda p: text.existing(p, ["frame_no", "no_such_column", "ttl_hlim"])), "select frame_no, ttl_hlim from pkt", "pkt")
add("align_features", on_packets(lambda p: text.aligned(p, ["flow_pkts", "dport"]).select("frame_no", "flow_pkts", "dport")), "select frame_no, 0 as flow_pkts, dport from pkt", "pkt")
_FLAG_SQL = {f"tcp_flag_{n}": f"(case when tcp_flags like '%{x}%' then 1 else 0 end)" for n, x in FLAG_LETTERS.items()}
add("model_feature_matrix", on_features(lambda f: matrix(f).select("frame_no", *[c(x).cast("double").alias(x) for x in TRAIN_FEATURES])),
    "select frame_no, " + names(f"cast(cast(coalesce({_FLAG_SQL.get(x, x)},0) as float) as double) as {x}" for x in TRAIN_FEATURES) + " from features", "features")
add("ml_matrix_float32", on_features(lambda f: f.select("frame_no", *[F.coalesce(c(x), lit(0)).cast("float").cast("double").alias(x) for x in ("len_bytes", "flow_iat_avg", "flow_iat_max")])), "select frame_no, cast(cast(len_bytes as float) as double) as len_bytes, cast(cast(flow_iat_avg as float) as double) as flow_iat_avg, cast(cast(flow_iat_max as float) as double) as flow_iat_max from features", "features")

# -- flow measures
for name, cols in {
    "flow_volume": ["flow_pkts", "flow_bytes"],
    "flow_duration": ["flow_duration"],
    "flow_iat": ["flow_iat_min", "flow_iat_avg", "flow_iat_max"],
    "flow_direction": ["flow_fwd_pkts", "flow_rev_pkts", "flow_fwd_bytes", "flow_rev_bytes"],
    "flow_tcp_flags": ["flow_syn_count", "flow_ack_count", "flow_fin_count", "flow_rst_count", "flow_psh_count"],
    "flow_syn_seen": ["flow_syn_seen", "flow_synack_seen"],
    "flow_ack_after_synack": ["flow_ack_seen_after_synack"],
    "flow_unique_ports": ["flow_unique_sports", "flow_unique_dports"],
    "flow_bad_ip_checksum": ["flow_bad_ip_checksum_count"],
    "flow_fragments": ["flow_frag_count"],
    "flow_low_ttl": ["flow_low_ttl_count"],
    "flow_unusual_dscp": ["flow_unusual_dscp_count"],
    "flow_bad_l4_checksum": ["flow_bad_l4_checksum_count"],
    "flow_ssh": SSH_SMB[:5],
    "flow_smb": SSH_SMB[5:],
    "flow_http": ["flow_http_seen", "flow_http_payload_detected", "flow_http_method", "flow_http_host", "flow_http_path"],
    "flow_http_port_fallback": ["flow_http_port_fallback", "flow_http_detect_source"],
    "flow_tls": ["flow_tls_seen", "flow_tls_payload_detected", "flow_tls_sni"],
    "flow_tls_port_fallback": ["flow_tls_port_fallback", "flow_tls_detect_source"],
    "flow_protocol_hint": ["flow_protocol_hint"],
    "flow_risk_score": ["flow_risk_score"],
    "flow_risk_level": ["flow_risk_level"],
    "flow_risk_reason": ["flow_risk_reason"],
}.items():
    add(name, on_flows(lambda f, cols=cols: f.select(*KEY, *cols)), f"select {names([*KEY, *cols])} from flow", "flow")

# -- running state
_STATE = [x for x in FEATURE_COLS if x.startswith("flow_")] + SSH_SMB
add("features_running_flow", on_packets(lambda p: running(p).select("frame_no", *_STATE)), f"select frame_no, {names(_STATE)} from rstate", "rstate")
add("packet_iat_lag", on_packets(lambda p: times_between(p).select("frame_no", (c("iat_us") / lit(1e6)).alias("iat"))), "select frame_no, iat/1e6 as iat from facts", "facts")
_COUNTS = ["src_ip_mac_seen_mac_count", "src_mac_ip_seen_ip_count"]
_SPOOF = ["src_ip_mac_consistent", "src_mac_ip_spoof_suspect"]
add("mac_ip_running", on_packets(lambda p: with_address_counts(p).select("frame_no", *_COUNTS)), f"select frame_no, {names(_COUNTS)} from macs", "macs")
add("mac_ip_spoof", on_packets(lambda p: with_address_counts(p).select("frame_no", *_SPOOF)), f"select frame_no, {names(_SPOOF)} from macs", "macs")
add("packet_mac_ip_state", on_packets(lambda p: with_address_counts(p).select("frame_no", "ip_src", "eth_src", *_COUNTS, *_SPOOF)), f"select frame_no, ip_src, eth_src, {names([*_COUNTS, *_SPOOF])} from macs", "macs")
add("packets_with_final_flow", lambda s, d: with_flow_key(packets(s, d)).select("frame_no", *KEY).join(flows(packets(s, d)).select(*KEY, "flow_pkts", "flow_risk_score"), KEY), f"select k.frame_no, {names('k.' + x for x in KEY)}, flow_pkts, flow_risk_score from keyed k join flow f on " + " and ".join(f"k.{x}=f.{x}" for x in KEY), "flow")

# -- packet scores
add("packet_heuristic_score", on_features(lambda f: with_heuristics(coerced(f)).select("frame_no", "heuristic_score")), "select frame_no, heuristic_score from heuristic", "heuristic")
add("packet_heuristic_reason", on_features(lambda f: with_heuristics(coerced(f)).select("frame_no", "heuristic_reason")), "select frame_no, heuristic_reason from heuristic", "heuristic")
add("packet_risk_level", on_scores(lambda s: s.select("frame_no", "risk_level")), "select frame_no, risk_level from scores", "scores")


def _address(k):
    """Public addresses by number, from 11.0.0.0 on: one each for 1.4 billion numbers."""
    octet = lambda n: F.floor(k / n).cast("long")
    return F.concat_ws(".", (octet(1 << 24) + 11).cast("string"), *[(octet(n) % 256).cast("string") for n in (1 << 16, 1 << 8, 1)])


def _address_sql(k: str) -> str:
    return f"cast(11+({k})//16777216 as varchar) || " + " || ".join(f"'.' || cast(({k})//{n}%256 as varchar)" for n in (1 << 16, 1 << 8, 1))


def reputation(spark: SparkSession, d: str) -> DataFrame:
    """A reputation dimension from all customers: ip, payload."""
    key = c("c_custkey").cast("long")
    score = F.when(key % 5 == 0, lit("")).when(key % 5 == 1, lit('"scamalytics_score":"n/a",')).otherwise(F.concat(lit('"scamalytics_score":"'), (key * 7 % 101).cast("string"), lit('.9",')))
    risk = F.when(key % 3 == 0, lit('"scamalytics_risk":null')).otherwise(F.concat(lit('"scamalytics_risk":" Risk'), (key % 4).cast("string"), lit('"')))
    return spark.read.parquet(f"{d}/customer.parquet").select(_address(key).alias("ip"), F.concat(lit('{"scamalytics":{'), score, risk, lit("}}")).alias("payload"))


_REP = f"""rep as (select {_address_sql('c_custkey')} as ip,
 case when c_custkey%5=0 then 0 when c_custkey%5=1 then null else c_custkey*7%101 end as rep_score,
 case when c_custkey%3<>0 then 'risk' || cast(c_custkey%4 as varchar) end as rep_risk, coalesce(case when c_custkey%3<>0 then 'risk' || cast(c_custkey%4 as varchar) end, 'scamalytics_unknown') as rep_reason
 from customer)"""


def public_packets(spark: SparkSession, d: str, of=packets) -> DataFrame:
    """Packets, or what `of` makes of them, with public addresses in places: six of seven are in the dimension."""
    most = spark.read.parquet(f"{d}/customer.parquet").agg(F.max("c_custkey")).first()[0] or 0  # one number
    ip = lambda m: _address(c("frame_no") * m % (most * 7 // 6 + 1) + 1)
    return of(spark, d).withColumns({"ip_src": F.when(c("frame_no") % 4 != 0, ip(3)).otherwise(c("ip_src")), "ip_dst": F.when(c("frame_no") % 3 == 0, ip(11)).otherwise(c("ip_dst"))})


def _ip_sql(m: int) -> str:
    return _address_sql(f"frame_no*{m}%(select max(c_custkey)*7//6+1 from customer)+1")


_LOOKED = f"""{_REP}, f as (select frame_no, case when frame_no%4<>0 then {_ip_sql(3)} end as s, case when frame_no%3=0 then {_ip_sql(11)} end as d from pkt),
 j as (select f.*, a.rep_score as s1, a.rep_risk as k1, a.rep_reason as r1, a.ip as i1, b.rep_score as s2, b.rep_risk as k2, b.rep_reason as r2, b.ip as i2 from f left join rep a on f.s=a.ip left join rep b on f.d=b.ip),
 ev as (select frame_no, 0 as side, i1 as ip from j where i1 is not null union all select frame_no, 1, i2 from j where i2 is not null and s1 is null),
 fi as (select ip, min(frame_no*2+side) as first from ev group by ip),
 u as (select j.*, case when s1 is not null then i1 when s2 is not null then i2 end as used, case when s1 is not null then 0 else 1 end as side, coalesce(s1, s2) as sc,
   case when s1 is not null then k1 else k2 end as ri, case when s1 is not null then r1 else r2 end as re from j),
 rp as (select frame_no, sc as rep_score, case when sc is not null then coalesce(ri, case when sc>=90 then 'very high' when sc>=70 then 'high' when sc>=40 then 'medium' else 'low' end) end as rep_level,
   case when sc is not null then case when frame_no*2+side=first then re else 'public_ip' end end as rep_reason from u left join fi on u.used=fi.ip)"""


def _with_rep(select: str, *sources: str) -> str:
    base = sql("#", *sources)
    return base.replace(" #", f", {_LOOKED} {select}")


add("reputation_scan", lambda s, d: reputation(s, d).select("ip"), f"with {_REP} select ip from rep")
add("reputation_json", lambda s, d: scoring.parsed_reputation(reputation(s, d)), f"with {_REP} select ip, rep_score, rep_risk, rep_reason from rep")
_REPUTED = ["frame_no", "rep_score", "rep_level"]
add("reputation_join", lambda s, d: scoring.with_reputation(public_packets(s, d), reputation(s, d)).select(*_REPUTED), _with_rep(f"select {names(_REPUTED)} from rp", "pkt"))
add("reputation_reason", lambda s, d: scoring.with_reputation(public_packets(s, d), reputation(s, d)).where("rep_reason is not null").select("frame_no", "rep_reason"), _with_rep("select frame_no, rep_reason from rp where rep_reason is not null", "pkt"))
add("packet_score", lambda s, d: scoring.scores(public_packets(s, d, lambda *x: features(packets(*x))), reputation(s, d)).select("frame_no", *SCORE_COLS),
    _with_rep("select s.frame_no, coalesce(rep_score, ip_fraud_score) as ip_fraud_score, cast(coalesce(rep_score, ip_fraud_score) as varchar) || '/100' as ip_fraud_score_display, coalesce(rep_level, risk_level) as risk_level, coalesce(rep_reason, risk_score_reason) as risk_score_reason from scores s join rp on s.frame_no=rp.frame_no", "scores"))

# -- dashboard
add("summary_counts", lambda s, d: dashboard.summary(features(packets(s, d)), scoring.scores(features(packets(s, d))), flows(packets(s, d))),
    "select 'features' as name, count(*) as n from features union all select 'scores', count(*) from scores union all select 'flows', count(*) from flow", "scores", "flow")
add("label_histogram", on_scores(lambda s: dashboard.histogram(s, "label")), "select 'unknown' as value, count(*) as n from scores", "scores")
add("risk_histogram", on_scores(lambda s: dashboard.histogram(s, "risk_level")), "select risk_level as value, count(*) as n from scores group by risk_level", "scores")
add("flow_risk_histogram", on_flows(lambda f: dashboard.histogram(f, "flow_risk_level")), "select flow_risk_level as value, count(*) as n from flow group by flow_risk_level", "flow")
add("score_avg", on_scores(dashboard.average_score), "select round(avg(ip_fraud_score), 2) as avg_score from scores", "scores")
_TOPP = f"select {names(TOP_PACKET_COLS)} from scores order by ip_fraud_score desc, frame_no limit 10"
_TOPF = f"select {names(TOP_FLOW_COLS)} from flow order by flow_risk_score desc, {names(KEY)} limit 10"
add("top_packets", on_scores(dashboard.top_packets), _TOPP, "scores")
add("export_top_packets", on_scores(lambda s: dashboard.top_packets(s).na.fill("")), _TOPP.replace("label", "coalesce(label, '') as label"), "scores")
add("top_flows", on_flows(dashboard.top_flows), _TOPF, "flow")
add("export_top_flows", on_flows(lambda f: dashboard.top_flows(f).na.fill("")), _TOPF, "flow")
add("records_page", on_scores(lambda s: dashboard.page(s, 2).select("frame_no", *SCORE_COLS)), f"select frame_no, {names(SCORE_COLS)} from scores order by frame_no limit 50 offset 50", "scores")
add("flows_page", on_flows(lambda f: dashboard.page(f, 2, order=("first_frame_no",)).select(*FLOW_COLS)), f"select {names(FLOW_COLS)} from flow order by first_frame_no limit 50 offset 50", "flow")
add("export_records", on_scores(lambda s: s), "select * from scores", "scores")
add("export_flows", on_flows(lambda f: f.select(*FLOW_COLS)), f"select {names(FLOW_COLS)} from flow", "flow")
add("page_count", on_flows(dashboard.page_count), "select count(*) as total, cast(ceil(count(*)/50.0) as bigint) as pages from flow", "flow")
_BASE = "(flow_http_method<>'' or flow_http_host<>'' or flow_tls_sni<>'' or flow_ssh_payload_detected>0 or flow_smb_payload_detected>0 or flow_protocol_hint<>'unknown')"
_BY = {
    "http": "(flow_protocol_hint='http' or flow_http_method<>'' or flow_http_host<>'')",
    "tls": "(flow_protocol_hint='tls' or flow_tls_sni<>'' or flow_tls_detect_source<>'')",
    "ssh": "(flow_protocol_hint='ssh' or flow_ssh_seen>0)",
    "smb": "(flow_protocol_hint='smb' or flow_smb_seen>0)",
}
_EV = f"select {names(EVIDENCE_COLS)} from flow where {_BASE}"
add("protocol_evidence_all", on_flows(dashboard.evidence), _EV, "flow")
for proto, rule in _BY.items():
    add(f"protocol_evidence_{proto}", on_flows(lambda f, proto=proto: dashboard.evidence(f, protocol=proto)), f"{_EV} and {rule}", "flow")
for src in ("payload", "port"):
    rule = " or ".join(f"flow_{x}_detect_source='{src}'" for x in dashboard.PROTOCOLS)
    add(f"protocol_evidence_source_{src}", on_flows(lambda f, src=src: dashboard.evidence(f, source=src)), f"{_EV} and ({rule})", "flow")
add("protocol_evidence_page", on_flows(lambda f: dashboard.evidence_page(f, 2)), f"{_EV} order by flow_risk_score desc, {names(dashboard.KEY_OF_EVIDENCE)} limit 9 offset 9", "flow")
add("export_protocol_evidence", on_flows(lambda f: dashboard.export_evidence(f, source="payload")),
    f"select {names(EVIDENCE_EXPORT_COLS)} from flow where case flow_protocol_hint when 'http' then flow_http_detect_source when 'tls' then flow_tls_detect_source when 'ssh' then flow_ssh_detect_source when 'smb' then flow_smb_detect_source else '' end = 'payload'", "flow")
add("protocol_summary_text", on_flows(dashboard.summary_text),
    f"""select {names(KEY)}, coalesce(nullif(flow_http_detect_source,''), nullif(flow_tls_detect_source,''), nullif(flow_ssh_detect_source,''), nullif(flow_smb_detect_source,''), 'unknown') as detect_source,
 trim(case flow_protocol_hint when 'http' then 'Client requested ' || case when flow_http_method='' then 'HTTP' else flow_http_method end || ' ' || flow_http_host || flow_http_path
  when 'tls' then 'Observed encrypted web session' || case when flow_tls_sni<>'' then ' to ' || flow_tls_sni else '' end
  when 'ssh' then 'Observed SSH session' || case when flow_ssh_banner<>'' then ' with banner ' || flow_ssh_banner else '' end
  when 'smb' then 'Observed ' || case when flow_smb_version='' then 'SMB' else flow_smb_version end || ' file-sharing traffic' else 'Protocol evidence observed.' end) as summary from flow""", "flow")
add("export_filename", on_packets(lambda p: p.select("frame_no", dashboard.export_name(F.timestamp_micros("ts_us"), "records", "csv").alias("name"))), "select frame_no, strftime(make_timestamp(ts_us), '%Y%m%d_%H%M') || '_records.csv' as name from pkt", "pkt")
add("flow_summary_lines", on_flows(dashboard.flow_lines),
    "select first_frame_no, flow_src_ip || ':' || cast(flow_src_port as varchar) || ' -> ' || flow_dst_ip || ':' || cast(flow_dst_port as varchar) || ' proto=' || cast(flow_proto as varchar) || ' pkts=' || cast(flow_pkts as varchar) || ' bytes=' || cast(flow_bytes as varchar) || ' dur=' || cast(cast(round(cast(flow_duration as decimal(30,12)),6) as decimal(30,6)) as varchar) || 's iat_min=' || cast(cast(round(cast(flow_iat_min as decimal(30,12)),6) as decimal(30,6)) as varchar) || 's iat_avg=' || cast(cast(round(cast(flow_iat_avg as decimal(30,12)),6) as decimal(30,6)) as varchar) || 's iat_max=' || cast(cast(round(cast(flow_iat_max as decimal(30,12)),6) as decimal(30,6)) as varchar) || 's' as line from flow", "flow")
_OK = "case when {0}=1 then 'OK' else 'BAD' end"


def capture_export(spark: SparkSession, d: str) -> DataFrame:
    """All packets as capture files, read back in splits, numbered and decoded."""
    capture.register(spark)
    path = shared_path(spark, "captures")
    frames = pcap.encoded(packets(spark, d)).repartitionByRange(partitions(spark), "frame_no").sortWithinPartitions("frame_no")
    frames.write.format("capture").mode("append").save(path)
    back = pcap.decoded(pcap.numbered(spark.read.format("capture").option("splitBytes", 1 << 22).load(path)))
    return back.select(*_DECODED, F.length("payload").cast("long").alias("size"))


_DECODED = "frame_no ts_us eth_src eth_dst vlan_id vlan_prio ip_version ip_tos dscp ecn ip_id ip_flags_df ip_flags_mf ip_frag_off ttl_hlim ip_proto ip_src ip_dst l4_proto sport dport tcp_flags tcp_win tcp_hdr_len ipv4_checksum_ok l4_checksum_ok".split()
_SIZES = "case evidence when 'http' then length('GET /p' || cast(k as varchar) || ' HTTP/1.1..User-Agent: x..Host: h' || cast(user_id as varchar) || '.example....') when 'reply' then 19 when 'ssh' then length('SSH-2.0-srv_' || cast(k as varchar)) + 2 when 'smb2' then 8 when 'smb1' then 4 when 'tls' then 65 + length('s' || cast(user_id as varchar) || '.example') when 'tls0' then 56 else 0 end"
add("capture_export", capture_export, f"select {names(_DECODED)}, cast({_SIZES} as bigint) as size from pkt", "pkt")
_SIX = "cast(cast({0} as decimal(19,0))/1000000 as decimal(19,6))"
# Payloads of the packet view as hex digits; of a hello as many as a preview shows.
_BYTES = f"""case evidence when 'http' then hex(encode('GET /p' || cast(k as varchar) || ' HTTP/1.1' || chr(13) || chr(10) || 'User-Agent: x' || chr(13) || chr(10)))
 when 'reply' then hex(encode('HTTP/1.1 200 OK' || chr(13) || chr(10) || chr(13) || chr(10))) when 'ssh' then hex(encode('SSH-2.0-srv_' || cast(k as varchar) || chr(13) || chr(10)))
 when 'smb2' then '0000002AFE534D42' when 'smb1' then 'FF534D42' when 'tls0' then '16030100330100002F0303' || repeat('00', 21)
 when 'tls' then '16030100' || lpad(hex(length(sni) + 60), 2, '0') || '010000' || lpad(hex(length(sni) + 56), 2, '0') || '0303' || repeat('00', 21) else '' end"""
add("frame_log_lines_all", on_packets(lambda p: dashboard.frame_lines(with_times(p))),
    f"""select frame_no, '=== Frame ' || cast(frame_no as varchar) || ' ===' || chr(10)
 || 'ts_epoch=' || cast({_SIX.format('ts_us')} as varchar) || ' ts_local=' || strftime(make_timestamp(ts_us - ts_us%1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(cast((ts_us//1000)%1000 as varchar), 3, '0') || ' t_rel=' || cast({_SIX.format('(ts_us - t0)')} as varchar) || 's' || chr(10)
 || 'L2: Ethernet src=' || eth_src || ' dst=' || eth_dst || ' type=' || eth_type || chr(10) || coalesce('  VLAN id=' || cast(vlan_id as varchar) || ' pri=' || cast(vlan_prio as varchar) || chr(10), '')
 || 'L3: IPv4 ' || ip_src || '->' || ip_dst || ' proto=' || cast(ip_proto as varchar) || ' ttl=' || cast(ttl_hlim as varchar) || ' id=' || cast(ip_id as varchar) || ' DSCP=' || cast(dscp as varchar) || ' ECN=' || cast(ecn as varchar) || ' frag_off=' || cast(ip_frag_off as varchar) || chr(10)
 || '  IPv4_checksum=' || {_OK.format('ipv4_checksum_ok')} || chr(10)
 || case when l4_proto=6 then 'L4: TCP ' || cast(sport as varchar) || '->' || cast(dport as varchar) || ' flags=' || tcp_flags || ' win=' || cast(tcp_win as varchar) else 'L4: UDP ' || cast(sport as varchar) || '->' || cast(dport as varchar) end || chr(10)
 || '  L4_checksum=' || {_OK.format('l4_checksum_ok')} || chr(10) || coalesce('TLS SNI=' || sni || chr(10), '')
 || coalesce('HTTP ' || hm || ' host=' || case when evidence='http' then hh else 'None' end || ' path=' || hp || chr(10), '')
 || 'PayloadPreview(' || cast(least(32, length(shown)//2) as varchar) || 'B): ' || trim(regexp_replace(lower(left(shown, 64)), '(..)', '\\1 ', 'g')) as line
 from (select *, {_BYTES} as shown from keyed) x, (select ts_us as t0 from pkt order by frame_no limit 1) t""", "facts")


def _log(spark: SparkSession, d: str) -> str:
    """The path of a written log of all packets and flows."""
    path, p = shared_path(spark, "log"), packets(spark, d)
    log.write_log(with_times(p), flows(p), path)
    return path


_LOGGED = "frame_no eth_src eth_dst eth_type vlan_id vlan_prio ip_version ip_src ip_dst ip_proto ttl_hlim ip_id dscp ecn ip_frag_off ipv4_checksum_ok l4_checksum_ok l4_proto sport dport tcp_flags tcp_win".split()
add("log_packets", lambda s, d: log.read_packets(s, _log(s, d)).select(*_LOGGED, F.coalesce("http_path", F.lit("")).alias("path"), F.coalesce("tls_sni", F.lit("")).alias("name")),
    f"select {names("nullif(tcp_flags, '') as tcp_flags" if c == 'tcp_flags' else c for c in _LOGGED)}, coalesce(hp, '') as path, coalesce(sni, '') as name from keyed", "facts")
add("log_lines", lambda s, d: log.read_flow_lines(s, _log(s, d)).select(F.length("line").cast("long").alias("size"), "line"),
    ORACLE_SQL["flow_summary_lines"].replace("select first_frame_no, ", "select cast(length(line) as bigint) as size, line from (select ", 1) + ") t")
