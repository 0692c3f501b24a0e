"""SQL for DuckDB that says the queries over, independently of the DataFrame code."""

from __future__ import annotations

from flowlens.plans.packets import PACKET_SQL
from flowlens.schema import EVIDENCE_COLS, EVIDENCE_EXPORT_COLS, FEATURE_COLS, FLOW_COLS, SCORE_COLS, TOP_FLOW_COLS, TOP_PACKET_COLS

PKT = PACKET_SQL.format(us="epoch_us(ts)", S="varchar")

KEYED = """
select *, case when fwd=1 then ip_src else ip_dst end as flow_src_ip, case when fwd=1 then ip_dst else ip_src end as flow_dst_ip,
 l4_proto as flow_proto, case when fwd=1 then sport else dport end as flow_src_port, case when fwd=1 then dport else sport end as flow_dst_port,
 case when tcp_flags like '%S%' then 1 else 0 end as s, case when tcp_flags like '%A%' then 1 else 0 end as a,
 case when l4_proto=6 then 1 else 0 end as tcp,
 case when evidence='ssh' then 'SSH-2.0-srv_' || cast(k as varchar) end as banner,
 case evidence when 'smb2' then 'SMB2/3' when 'smb1' then 'SMB1' end as smb,
 case evidence when 'http' then 'GET' when 'reply' then 'RESP' end as hm,
 case evidence when 'http' then 'h' || cast(user_id as varchar) || '.example' when 'reply' then '' end as hh,
 case evidence when 'http' then '/p' || cast(k as varchar) when 'reply' then 'HTTP/1.1 200 OK' end as hp,
 case evidence when 'tls' then 's' || cast(user_id as varchar) || '.example' end as sni
from (select *, case when ip_src<ip_dst or (ip_src=ip_dst and sport<=dport) then 1 else 0 end as fwd from pkt) z
"""
KEY = "flow_src_ip, flow_dst_ip, flow_proto, flow_src_port, flow_dst_port"
FACTS = f"""
select *, ts_us - lag(ts_us) over (partition by {KEY} order by frame_no) as iat,
 min(case when s=1 and a=1 then frame_no end) over (partition by {KEY}) as f0,
 min(case when hm is not null then frame_no end) over (partition by {KEY}) as http_at,
 min(case when evidence in ('tls','tls0') then frame_no end) over (partition by {KEY}) as tls_at
from keyed
"""


def _measures(over: str) -> str:
    def agg(f, x):
        return f"{f}({x}) {over}"

    def n(cond):
        return f"cast(coalesce({agg('sum', f'case when {cond} then 1 else 0 end')},0) as bigint)"

    def any_(cond):
        return f"cast({agg('max', f'case when {cond} then 1 else 0 end')} as int)"

    first, last = agg("min", "frame_no"), agg("max", "frame_no")
    out = {
        "flow_pkts": f"cast({agg('count', '*')} as bigint)",
        "flow_bytes": f"cast({agg('sum', 'len_bytes')} as bigint)",
        "dur_us": f"{agg('max', 'case when frame_no=last_no then ts_us end')} - {agg('max', 'case when frame_no=first_no then ts_us end')}" if not over else "ts_us - first_us",
        "flow_iat_min": f"coalesce({agg('min', 'iat')},0)/1e6",
        "flow_iat_max": f"coalesce({agg('max', 'iat')},0)/1e6",
        "flow_fwd_pkts": n("fwd=1"), "flow_rev_pkts": n("fwd=0"),
        "flow_fwd_bytes": f"cast({agg('sum', 'case when fwd=1 then len_bytes else 0 end')} as bigint)",
        "flow_rev_bytes": f"cast({agg('sum', 'case when fwd=0 then len_bytes else 0 end')} as bigint)",
        "flow_syn_count": n("s=1"), "flow_ack_count": n("a=1"), "flow_fin_count": n("tcp_flags like '%F%'"),
        "flow_rst_count": n("tcp_flags like '%R%'"), "flow_psh_count": n("tcp_flags like '%P%'"),
        "flow_syn_seen": any_("s=1 and a=0"), "flow_synack_seen": any_("s=1 and a=1"),
        "flow_ack_seen_after_synack": any_("a=1 and s=0 and frame_no>f0"),
        "flow_bad_ip_checksum_count": n("ipv4_checksum_ok=0"),
        "flow_bad_l4_checksum_count": n("l4_checksum_ok=0 and not (tcp=1 and tcp_flags='A')"),
        "flow_frag_count": n("ip_flags_mf=1 or ip_frag_off>0"), "flow_low_ttl_count": n("ttl_hlim>0 and ttl_hlim<20"),
        "flow_unusual_dscp_count": n("dscp not in (0,8,16,24,32,46)"),
        "flow_unique_sports": f"1 + {any_('fwd=1')} * {any_('fwd=0')}" , "flow_unique_dports": f"1 + {any_('fwd=1')} * {any_('fwd=0')}",
        "first_frame_no": first, "last_frame_no": last,
        "http_port": any_("tcp=1 and (sport in (80,8080,8000,8888) or dport in (80,8080,8000,8888))"),
        "tls_port": any_("tcp=1 and (sport=443 or dport=443)"),
        "ssh_port": any_("tcp=1 and (sport=22 or dport=22)"), "smb_port": any_("tcp=1 and (sport=445 or dport=445)"),
        "ssh_proof": any_("banner is not null"), "smb_proof": any_("smb is not null"),
        "ssh_last": agg("max", "case when banner is not null then frame_no end"), "smb_last": agg("max", "case when smb is not null then frame_no end"),
        "http_at": agg("max", "http_at"), "tls_at": agg("max", "tls_at"),
    }
    return ", ".join(f"{v} as {k}" for k, v in out.items())


_AT = ", ".join(f"max(case when frame_no={at} then {x} end) as {n}" for at, x, n in (("http_at", "hm", "v_hm"), ("http_at", "hh", "v_hh"), ("http_at", "hp", "v_hp"), ("tls_at", "sni", "v_sni"), ("ssh_at", "banner", "v_banner"), ("smb_at", "smb", "v_smb")))
VALUES = f"""
select {KEY}, {_AT}, max(ssh_at) as ssh_at, max(smb_at) as smb_at
from (select *, min(case when banner is not null then frame_no end) over (partition by {KEY}) as ssh_at,
       min(case when smb is not null then frame_no end) over (partition by {KEY}) as smb_at from facts) v0 group by {KEY}
"""
MEASURED = f"""
select {KEY}, {_measures('')} from
 (select *, min(frame_no) over (partition by {KEY}) as first_no, max(frame_no) over (partition by {KEY}) as last_no from facts) m0 group by {KEY}
"""
RUNNING = f"""
select frame_no, {KEY}, {_measures('over w')} from
 (select *, first_value(ts_us) over (partition by {KEY} order by frame_no) as first_us from facts) r0
 window w as (partition by {KEY} order by frame_no rows between unbounded preceding and current row)
"""


def _evidence(source: str) -> str:
    """HTTP, TLS, SSH and SMB columns, hint and risk of `source`, as of its last_frame_no."""
    return f"""
select *, case when flow_risk_score>=70 then 'high' when flow_risk_score>=40 then 'medium' else 'low' end as flow_risk_level from (
select *, least(100, {' + '.join(f"case when {c} then {p} else 0 end" for c, p, _ in RULES)}) as flow_risk_score,
 coalesce(nullif(concat_ws(',', {', '.join(f"case when {c} then '{r}' end" for c, _, r in RULES if r)}), ''), 'flow_normal') as flow_risk_reason from (
select *, case when flow_http_payload_detected=1 then 'http' when flow_tls_sni<>'' or flow_tls_payload_detected=1 then 'tls'
  when flow_http_port_fallback=1 then 'http' when flow_tls_port_fallback=1 then 'tls' when flow_ssh_seen=1 then 'ssh' when flow_smb_seen=1 then 'smb' else 'unknown' end as flow_protocol_hint from (
select e.*, greatest(hp1, http_port) as flow_http_seen, hp1 as flow_http_payload_detected, case when hp1=0 then http_port else 0 end as flow_http_port_fallback,
 case when hp1=1 then 'payload' when http_port=1 then 'port' else '' end as flow_http_detect_source,
 case when hp1=1 then v_hm else '' end as flow_http_method, case when hp1=1 then v_hh else '' end as flow_http_host, case when hp1=1 then v_hp else '' end as flow_http_path,
 greatest(tp1, tls_port) as flow_tls_seen, tp1 as flow_tls_payload_detected, case when tp1=0 then tls_port else 0 end as flow_tls_port_fallback,
 case when tp1=1 then 'payload' when tls_port=1 then 'port' else '' end as flow_tls_detect_source, case when tp1=1 then v_sni else '' end as flow_tls_sni,
 {', '.join(f'''greatest({p}_proof, {p}_port) as flow_{p}_seen, {p}_proof as flow_{p}_payload_detected,
 case when {p}_proof=1 and {p}_last=last_frame_no then 0 when {p}_port=1 then 1 else 0 end as flow_{p}_port_fallback,
 case when {p}_proof=1 then 'payload' when {p}_port=1 then 'port' else '' end as flow_{p}_detect_source,
 case when {p}_proof=1 then v_{v} else '' end as flow_{p}_{n}''' for p, v, n in (('ssh', 'banner', 'banner'), ('smb', 'smb', 'version')))}
from (select x.*, v_hm, v_hh, v_hp, v_sni, v_banner, v_smb,
  case when x.http_at<=last_frame_no then 1 else 0 end as hp1, case when x.tls_at<=last_frame_no and v_sni is not null then 1 else 0 end as tp1,
  dur_us/1e6 as flow_duration, case when flow_pkts>1 then dur_us/1e6/(flow_pkts-1) else 0.0 end as flow_iat_avg
 from {source} x join vals v on x.flow_src_ip=v.flow_src_ip and x.flow_dst_ip=v.flow_dst_ip and x.flow_proto=v.flow_proto and x.flow_src_port=v.flow_src_port and x.flow_dst_port=v.flow_dst_port) e
) g) h) i
"""


RULES = [
    ("flow_bad_ip_checksum_count>0", 25, "flow_bad_ip_checksum"),
    ("flow_bad_l4_checksum_count>=3", 10, "flow_bad_l4_checksum"),
    ("flow_bad_l4_checksum_count=2", 5, None),
    ("flow_frag_count>0", 10, "flow_fragmented"),
    ("flow_low_ttl_count>0", 8, "flow_low_ttl"),
    ("flow_unusual_dscp_count>0", 5, "flow_unusual_dscp"),
    ("flow_syn_count>3 and flow_ack_count=0", 20, "syn_without_ack"),
    ("flow_rst_count>2", 10, "many_rst"),
    ("flow_syn_seen=1 and flow_synack_seen=0", 15, "incomplete_handshake_no_synack"),
    ("flow_syn_seen=1 and flow_synack_seen=1 and flow_ack_seen_after_synack=0", 12, "incomplete_handshake_no_final_ack"),
    ("flow_fwd_pkts>=6 and flow_rev_pkts=0", 15, "direction_imbalance_no_response"),
    ("flow_fwd_pkts>=10 and flow_rev_pkts>0 and flow_fwd_pkts>=4*flow_rev_pkts", 10, "direction_imbalance"),
    ("flow_unique_dports>5", 15, "multi_port_targeting"),
    ("dur_us<1000000 and flow_pkts>10", 10, "short_burst_flow"),
]
PACKET_RULES = [
    ("ipv4_checksum_ok=0", "35", "ipv4_checksum_ok=0", "ipv4_checksum_bad"),
    ("l4_checksum_ok=0", "25", "l4_checksum_ok=0 and tcp_flags<>'A'", "l4_checksum_bad"),
    ("ip_flags_mf=1 or ip_frag_off>0", "10", "ip_flags_mf=1 or ip_frag_off>0", "fragmented_packet"),
    ("src_ip_mac_consistent=0", "20", "src_ip_mac_consistent=0", "src_ip_mac_inconsistent"),
    ("ttl_hlim>0 and ttl_hlim<20", "10", "ttl_hlim>0 and ttl_hlim<20", "low_ttl"),
    ("tcp_flags like '%SF%' or tcp_flags=''", "5", "tcp_flags like '%SF%' or tcp_flags=''", "suspicious_tcp_flags"),
    ("dscp not in (0,8,16,24,32,46)", "3", "dscp not in (0,8,16,24,32,46)", "unusual_dscp"),
    ("dport in (22,80,443,445)", "2", "dport in (22,80,443,445)", "focus_port"),
    ("flow_risk_score>0", "least(25, flow_risk_score//2)", "flow_risk_score>=40", "flow_behavior_suspicious"),
    ("flow_syn_count>3 and flow_ack_count=0", "10", "flow_syn_count>3 and flow_ack_count=0", "syn_without_ack"),
]
MACS = """
select *, case when ms>1 then 0 else 1 end as src_ip_mac_consistent, cast(ms as int) as src_ip_mac_seen_mac_count, cast(ips as int) as src_mac_ip_seen_ip_count,
 case when ms>1 or ips>5 then 1 else 0 end as src_mac_ip_spoof_suspect
from (select *, sum(nw) over (partition by ip_src order by frame_no rows unbounded preceding) as ms, sum(nw) over (partition by eth_src order by frame_no rows unbounded preceding) as ips
 from (select *, case when row_number() over (partition by ip_src, eth_src order by frame_no)=1 then 1 else 0 end as nw from pkt) a0) a1
"""
TIMED = """
select m.*, ts_us/1e6 as ts_epoch, (ts_us - t0)/1e6 as t_rel,
 ' ' || strftime(make_timestamp(ts_us - ts_us%1000), '%Y-%m-%d %H:%M:%S') || '.' || lpad(cast((ts_us//1000)%1000 as varchar), 3, '0') as ts_local
from macs m, (select ts_us as t0 from pkt order by frame_no limit 1) t
"""
_FLOW_FEATURES = [c for c in FEATURE_COLS if c.startswith("flow_")]
FEATURES = f"select t.*, {', '.join('r.' + c for c in _FLOW_FEATURES)} from timed t join rstate r on t.frame_no=r.frame_no"
HEURISTIC = f"""
select *, least(100, {' + '.join(f"case when {c} then {p} else 0 end" for c, p, _, _ in PACKET_RULES)}) as heuristic_score,
 coalesce(nullif(concat_ws(',', {', '.join(f"case when {c} then '{r}' end" for _, _, c, r in PACKET_RULES)}), ''), 'heuristic_normal') as heuristic_reason
from features
"""
LEVEL = "case when {0}>=90 then 'very high' when {0}>=70 then 'high' when {0}>=40 then 'medium' else 'low' end"
FLAGS = ", ".join(f"case when tcp_flags like '%{x}%' then 1 else 0 end as tcp_flag_{n}" for n, x in (("SYN", "S"), ("ACK", "A"), ("FIN", "F"), ("RST", "R"), ("PSH", "P"), ("URG", "U")))
SCORES = f"""
select {', '.join(FEATURE_COLS)}, {FLAGS}, cast(null as varchar) as label, heuristic_score as ip_fraud_score,
 cast(heuristic_score as varchar) || '/100' as ip_fraud_score_display, {LEVEL.format('heuristic_score')} as risk_level, heuristic_reason as risk_score_reason
from heuristic
"""
CTES = {
    "pkt": PKT, "keyed": KEYED, "facts": FACTS, "vals": VALUES, "measured": MEASURED, "flow": _evidence("measured"),
    "running": RUNNING, "rstate": _evidence("running"), "macs": MACS, "timed": TIMED, "features": FEATURES, "heuristic": HEURISTIC, "scores": SCORES,
}
#: What each needs, itself last.
NEEDS = {
    "pkt": ["pkt"], "keyed": ["pkt", "keyed"], "facts": ["pkt", "keyed", "facts"],
    "flow": ["pkt", "keyed", "facts", "vals", "measured", "flow"],
    "rstate": ["pkt", "keyed", "facts", "vals", "running", "rstate"],
    "macs": ["pkt", "macs"], "timed": ["pkt", "macs", "timed"],
    "features": ["pkt", "keyed", "facts", "vals", "running", "rstate", "macs", "timed", "features"],
}
NEEDS["heuristic"] = [*NEEDS["features"], "heuristic"]
NEEDS["scores"] = [*NEEDS["heuristic"], "scores"]


def sql(select: str, *sources: str) -> str:
    """select, over the sources named."""
    names = dict.fromkeys(n for s in sources for n in NEEDS[s])
    return "with " + ", ".join(f"{n} as materialized ({CTES[n]})" for n in names) + f" {select}"


def columns(names: list[str]) -> str:
    return ", ".join(names)


__all__ = ["EVIDENCE_COLS", "EVIDENCE_EXPORT_COLS", "FLOW_COLS", "SCORE_COLS", "TOP_FLOW_COLS", "TOP_PACKET_COLS", "columns", "sql"]
