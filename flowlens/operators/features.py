"""The feature table: header fields, address consistency and running flow state per packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.header import ts_local
from flowlens.operators.flowkey import with_flow_key
from flowlens.operators.flows import KEY, SEGMENT, running, running_sizes
from flowlens.operators.reassembly import reassembled
from flowlens.schema import FEATURE_COLS, SSH_SMB, TRAIN_FEATURES


def with_address_counts(packets: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Running numbers of MACs per source IP and IPs per source MAC, and what follows from them.

    A pair counts where it comes first; sums of these are running distinct counts.
    Pairs are gathered by segments of frame numbers, a row each: they tell where a
    pair comes first, and how many pairs an address has had before a segment.
    Packets sum up inside a segment of their address only, so one address with all
    packets, or packets without one, make no large task.
    """
    known = "trim(ip_src) is not null and lower(trim(eth_src)) is not null"
    df = packets.selectExpr("*", f"if({known}, trim(ip_src), null) as _ip", f"if({known}, lower(trim(eth_src)), null) as _mac", f"frame_no div {width} as _segment")
    pairs = df.where("_ip is not null").groupBy("_ip", "_mac", "_segment").agg(F.min("frame_no").alias("_first"))
    pairs = pairs.selectExpr("*", "cast(_first = min(_first) over (partition by _ip, _mac) as bigint) as _new")
    df = df.join(pairs.where("_new = 1").select(F.col("_first").alias("frame_no"), "_new"), "frame_no", "left")
    for key, count in (("_ip", "_macs"), ("_mac", "_ips")):
        sums = pairs.groupBy(key, "_segment").agg(F.sum("_new").alias("_n"))
        before = sums.selectExpr(key, "_segment", f"sum(_n) over (partition by {key} order by _segment rows between unbounded preceding and 1 preceding) as _before")
        df = df.selectExpr("*", f"sum(_new) over (partition by {key}, _segment order by frame_no rows between unbounded preceding and current row) as _own")
        df = df.join(before, [key, "_segment"], "left").selectExpr("*", f"if(_ip is null, 0, cast(coalesce(_own, 0) + coalesce(_before, 0) as int)) as {count}").drop("_own", "_before")
    return df.selectExpr(
        *packets.columns,
        "if(_ip is null, null, cast(_macs <= 1 as int)) as src_ip_mac_consistent", "_macs as src_ip_mac_seen_mac_count", "_ips as src_mac_ip_seen_ip_count",
        "if(_ip is null, 0, cast(_macs > 1 or _ips > 5 as int)) as src_mac_ip_spoof_suspect",
    )


def with_times(packets: DataFrame) -> DataFrame:
    """ts_epoch, t_rel since the first packet of all, and ts_local."""
    start = packets.agg(F.min_by("ts_us", "frame_no").alias("_start"))  # one row
    df = packets.crossJoin(F.broadcast(start))
    return df.withColumns(
        {"ts_epoch": F.col("ts_us") / F.lit(1e6), "t_rel": (F.col("ts_us") - F.col("_start")) / F.lit(1e6), "ts_local": ts_local(F.col("ts_us"))}
    ).drop("_start")


def features(packets: DataFrame, wide: bool = False, width: int = SEGMENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 78-column feature table; `wide` adds the SSH and SMB columns, `keep` other columns of packets."""
    flows = [c for c in FEATURE_COLS if c.startswith("flow_")] + SSH_SMB
    evidence = reassembled(with_flow_key(packets).where("flow_proto is not null"), width)
    df = running(with_address_counts(with_times(packets), width), width, evidence)
    return _filled(df, flows).select(*FEATURE_COLS, *(SSH_SMB if wide else []), *keep)


def _filled(df: DataFrame, flows: list[str]) -> DataFrame:
    """df with what packets of no flow have in the columns of flows."""
    texts = {"flow_protocol_hint": "unknown", "flow_risk_level": "low", "flow_risk_reason": "flow_normal"}
    kinds = dict(df.dtypes)
    in_flow = F.col("flow_proto").isNotNull()
    fill = {c: F.coalesce(F.when(in_flow, F.col(c)), F.lit(texts.get(c, "") if kinds[c] == "string" else 0).cast(kinds[c])) for c in flows}
    return df.withColumns(fill)


def seen_features(packets: DataFrame, width: int = SEGMENT, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of features() that models are made of, and frame_no and tcp_flags: payloads, counts of addresses and local times are none of them."""
    seen = [c for c in FEATURE_COLS if c in {"frame_no", "tcp_flags", *TRAIN_FEATURES}]
    return _filled(running_sizes(packets, width), [c for c in seen if c.startswith("flow_")]).select(*seen, *keep)


__all__ = ["KEY", "features", "seen_features", "with_address_counts", "with_times"]
