"""Rule scores: points and reasons in one table each, in order of evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.text import number
from flowlens.schema import COERCED, FOCUS_PORTS, LOW_TTL, USUAL_DSCP


def flow_rules() -> list[tuple[Column, int, str | None]]:
    """(condition, points, reason) of the flow score."""
    c = lambda n: F.coalesce(F.col(f"flow_{n}"), F.lit(0))
    syn, synack = c("syn_seen") == 1, c("synack_seen") == 1
    silent = (c("fwd_pkts") >= 6) & (c("rev_pkts") == 0)
    uneven = (c("fwd_pkts") >= 10) & (c("rev_pkts") > 0) & (c("fwd_pkts") >= 4 * c("rev_pkts"))
    return [
        (c("bad_ip_checksum_count") > 0, 25, "flow_bad_ip_checksum"),
        (c("bad_l4_checksum_count") >= 3, 10, "flow_bad_l4_checksum"),
        (c("bad_l4_checksum_count") == 2, 5, None),
        (c("frag_count") > 0, 10, "flow_fragmented"),
        (c("low_ttl_count") > 0, 8, "flow_low_ttl"),
        (c("unusual_dscp_count") > 0, 5, "flow_unusual_dscp"),
        ((c("syn_count") > 3) & (c("ack_count") == 0), 20, "syn_without_ack"),
        (c("rst_count") > 2, 10, "many_rst"),
        (syn & ~synack, 15, "incomplete_handshake_no_synack"),
        (syn & synack & (c("ack_seen_after_synack") == 0), 12, "incomplete_handshake_no_final_ack"),
        (silent, 15, "direction_imbalance_no_response"),
        (~silent & uneven, 10, "direction_imbalance"),
        (c("unique_dports") > 5, 15, "multi_port_targeting"),
        ((c("duration") < 1.0) & (c("pkts") > 10), 10, "short_burst_flow"),
    ]


def packet_rules() -> list[tuple[Column, int | Column, Column | bool, str]]:
    """(condition, points, condition of the reason, reason) of the packet heuristics, over coerced columns."""
    c = F.col
    flags, flow = F.coalesce(c("tcp_flags"), F.lit("")), F.coalesce(c("flow_risk_score"), F.lit(0))
    bad_l4 = c("l4_checksum_ok") == 0
    return [
        (c("ipv4_checksum_ok") == 0, 35, True, "ipv4_checksum_bad"),
        (bad_l4, 25, flags != "A", "l4_checksum_bad"),
        ((c("ip_flags_mf") == 1) | (c("ip_frag_off") > 0), 10, True, "fragmented_packet"),
        (F.coalesce(c("src_ip_mac_consistent") == 0, F.lit(False)), 20, True, "src_ip_mac_inconsistent"),
        ((c("ttl_hlim") > 0) & (c("ttl_hlim") < LOW_TTL), 10, True, "low_ttl"),
        (F.contains(flags, F.lit("SF")) | (flags == ""), 5, True, "suspicious_tcp_flags"),
        (~c("dscp").isin(*USUAL_DSCP), 3, True, "unusual_dscp"),
        (c("dport").isin(*FOCUS_PORTS), 2, True, "focus_port"),
        (flow > 0, F.least(F.lit(25), F.floor(flow / 2).cast("int")), flow >= 40, "flow_behavior_suspicious"),
        (F.coalesce(c("flow_unique_dports"), F.lit(0)) > 5, 10, True, "multi_port_targeting"),
        ((F.coalesce(c("flow_syn_count"), F.lit(0)) > 3) & (F.coalesce(c("flow_ack_count"), F.lit(0)) == 0), 10, True, "syn_without_ack"),
    ]


def _clamped(points: list[Column]) -> Column:
    total = F.lit(0)
    for p in points:
        total = total + p
    return F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int")


def _reasons(parts: list[Column], none: str) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(",", *parts), F.lit("")), F.lit(none))


def with_flow_risk(flows: DataFrame) -> DataFrame:
    """Adds flow_risk_score, flow_risk_level and flow_risk_reason."""
    rules = flow_rules()
    score = _clamped([F.when(when, points).otherwise(0) for when, points, _ in rules])
    reason = _reasons([F.when(when, F.lit(name)) for when, _, name in rules if name], "flow_normal")
    flows = flows.withColumns({"flow_risk_score": score, "flow_risk_reason": reason})
    level = F.when(F.col("flow_risk_score") >= 70, "high").when(F.col("flow_risk_score") >= 40, "medium").otherwise("low")
    return flows.withColumn("flow_risk_level", level)


def coerced(features: DataFrame) -> DataFrame:
    """The seven scored columns as numbers: anything else, NULL too, is 0 and so a bad checksum."""
    return features.withColumns({c: number(F.col(c), 0).cast("int") for c in COERCED})


def with_heuristics(features: DataFrame) -> DataFrame:
    """Adds heuristic_score and heuristic_reason to coerced features."""
    rules = packet_rules()
    score = _clamped([F.when(when, points).otherwise(0) for when, points, _, _ in rules])
    reason = _reasons([F.when(when & (F.lit(True) if more is True else more), F.lit(name)) for when, _, more, name in rules], "heuristic_normal")
    return features.withColumns({"heuristic_score": score, "heuristic_reason": reason})
