"""Flow state: one set of accumulators, as a final table per flow or running per packet.

Order is that of arrival, frame_no.  Flows are cut into segments of frame numbers,
so that no task gets more than a segment of a flow, however long that is.  Every
accumulator has a way to be merged: segments are summed up by themselves, a scan
over a flow's segments gives what stands before each of them, and packets add
that to what their own segment had so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.payload import http_head, server_name, smb_version, ssh_banner
from flowlens.operators.flowkey import KEY, with_flow_key
from flowlens.operators.reassembly import reassembled
from flowlens.operators.rules import with_flow_risk
from flowlens.schema import FLOW_COLS, HTTP_BUFFER, HTTP_PORTS, LOW_TTL, SMB_PORT, SSH_PORT, TLS_PORT, USUAL_DSCP

#: Frame numbers of a segment: the most packets of one flow that a task holds.
SEGMENT = 1 << 18


def with_proofs(packets: DataFrame) -> DataFrame:
    """Flow key, direction and payload evidence of each packet; few payloads are looked at closely."""
    data = F.col("payload")
    banner = F.when((F.col("l4_proto") == 6) & F.contains(data, F.lit(b"SSH-")), ssh_banner(data))
    smb = F.when((F.col("l4_proto") == 6) & F.contains(data, F.lit(b"SMB")), smb_version(data))
    return with_flow_key(packets).withColumns({"_banner": banner, "_smb": smb})


def _has(letter: str) -> str:
    return f"contains(upper(coalesce(tcp_flags, '')), '{letter}')"


def _either_sql(*ports: int) -> str:
    listed = ", ".join(map(str, ports))
    return f"(sport in ({listed}) or dport in ({listed}))"


def accumulators() -> dict[str, tuple[str, str]]:
    """What is gathered of a flow: name -> (kind, a packet's value as SQL).

    sum, least and greatest are over values; first and last are the value, if
    any, of the earliest and latest packet that has one.  iat_us is the time
    since the flow's last packet.  SQL texts are one call each to build, where
    columns would be some hundred.
    """
    s, a, tcp, v4 = _has("S"), _has("A"), "l4_proto = 6", "ip_version = 4"
    count = lambda x: ("sum", f"cast(coalesce({x}, false) as bigint)")
    seen = lambda x: ("greatest", f"cast(coalesce({x}, false) as int)")
    out = {
        "pkts": ("sum", "1L"),
        "bytes": ("sum", "cast(len_bytes as bigint)"),
        "start": ("first", "ts_us"),
        "end": ("last", "ts_us"),
        "iat_min_us": ("least", "iat_us"),
        "iat_max_us": ("greatest", "iat_us"),
        "fwd_pkts": count("fwd"),
        "rev_pkts": count("not fwd"),
        "fwd_bytes": ("sum", "cast(if(fwd, len_bytes, 0) as bigint)"),
        "rev_bytes": ("sum", "cast(if(not fwd, len_bytes, 0) as bigint)"),
        "syn_count": count(f"{tcp} and {s}"),
        "ack_count": count(f"{tcp} and {a}"),
        "fin_count": count(f"{tcp} and {_has('F')}"),
        "rst_count": count(f"{tcp} and {_has('R')}"),
        "psh_count": count(f"{tcp} and {_has('P')}"),
        "syn_seen": seen(f"{tcp} and {s} and not {a}"),
        "synack_at": ("least", f"if({tcp} and {s} and {a}, frame_no, null)"),
        "ack_at": ("greatest", f"if({tcp} and {a} and not {s}, frame_no, null)"),
        "bad_ip_checksum_count": count(f"{v4} and coalesce(ipv4_checksum_ok, 1) = 0"),
        "bad_l4_checksum_count": count(f"coalesce(l4_checksum_ok, 1) = 0 and not coalesce({tcp} and coalesce(tcp_flags, '') = 'A', false)"),
        "frag_count": count(f"{v4} and (ip_flags_mf = 1 or ip_frag_off > 0)"),
        "low_ttl_count": count(f"{v4} and ttl_hlim > 0 and ttl_hlim < {LOW_TTL}"),
        "unusual_dscp_count": count(f"{v4} and dscp not in ({', '.join(map(str, USUAL_DSCP))})"),
        "first_frame_no": ("least", "frame_no"),
        "last_frame_no": ("greatest", "frame_no"),
        "http_port": seen(f"{tcp} and {_either_sql(*HTTP_PORTS)}"),
        "tls_port": seen(f"{tcp} and {_either_sql(TLS_PORT)}"),
    }
    for port in ("sport", "dport"):
        out |= {f"{port}_low": ("least", port), f"{port}_high": ("greatest", port)}
    for name, found, port in (("ssh", "_banner", SSH_PORT), ("smb", "_smb", SMB_PORT)):
        proof, by_port = f"{found} is not null", f"{tcp} and {_either_sql(port)}"
        out |= {
            f"{name}_payload_detected": seen(proof),
            f"{name}_seen": seen(f"{proof} or {by_port}"),
            f"{name}_fallback": ("last", f"case when {proof} then 0 when {by_port} then 1 end"),
            f"{name}_found": ("first", found),
        }
    return out


#: Accumulators of a flow's packets, bytes and times.
SIZES = ("pkts", "bytes", "start", "end", "iat_min_us", "iat_max_us")
KINDS = {name: kind for name, (kind, _) in accumulators().items()}
_AGGREGATE = {"sum": "sum", "least": "min", "greatest": "max", "first": "min", "last": "max"}


def _gathered(name: str) -> str:
    """SQL of an accumulator over packets; first and last hold the frame number before the value."""
    kind, value = accumulators()[name]
    if kind in ("first", "last"):
        value = f"if(({value}) is null, null, struct(frame_no as at, {value} as value))"
    return f"{_AGGREGATE[kind]}({value})"


def _merged(name: str, *parts: str) -> str:
    if KINDS[name] == "sum":
        return " + ".join(f"coalesce({p}, 0L)" for p in parts)
    return f"{'least' if KINDS[name] in ('least', 'first') else 'greatest'}({', '.join(parts)})"


def _in_segments(keyed: DataFrame, width: int) -> DataFrame:
    """Adds _flow, _segment and iat_us since the flow's last packet in the segment."""
    lone = ", _lone" if "_lone" in keyed.columns else ""
    df = keyed.selectExpr("*", f"struct({', '.join(KEY)}{lone}) as _flow", f"frame_no div {width} as _segment")
    return df.selectExpr("*", "ts_us - lag(ts_us) over (partition by _flow, _segment order by frame_no) as iat_us")


def _segment_sums(packets: DataFrame, names: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """_flow, _segment and the accumulators of each segment, with the time to the segment before in iat_*; names: which, of them SIZES at least."""
    sums = packets.groupBy("_flow", "_segment").agg(*[F.expr(f"{_gathered(name)} as {name}") for name in names])
    # A row per segment of a flow.
    sums = sums.selectExpr("*", "start.value - lag(end.value) over (partition by _flow order by _segment) as _gap")
    kept = [n for n in names if not n.startswith("iat_")]
    return sums.selectExpr("_flow", "_segment", *kept, "least(iat_min_us, _gap) as iat_min_us", "greatest(iat_max_us, _gap) as iat_max_us")


def _measures(prefix: str = "", placed: bool = True) -> list[str]:
    """SQL of a flow's measures of its accumulators; those of counts and times are 0 where there is none; placed: first and last hold frame numbers."""
    value = lambda n: f"{prefix}{n}.value" if placed and KINDS[n] in ("first", "last") else f"{prefix}{n}"
    plain = [n for n in KINDS if n.endswith(("_us", "pkts", "bytes", "_count", "_seen", "_port", "_detected"))]
    out = {n: f"coalesce({value(n)}, 0)" for n in plain} | {n: value(n) for n in ("first_frame_no", "last_frame_no")}
    out |= {
        "duration_us": f"coalesce({value('end')} - {value('start')}, 0L)",
        "synack_seen": f"cast({value('synack_at')} is not null as int)",
        "ack_seen_after_synack": f"cast(coalesce({value('ack_at')} > {value('synack_at')}, false) as int)",
    }
    for port in ("sport", "dport"):  # of which a flow has at most its key's two
        out[f"unique_{port}s"] = f"cast(coalesce(1 + cast({value(port + '_low')} <> {value(port + '_high')} as int), 0) as bigint)"
    for proto in ("ssh", "smb"):
        out |= {f"{proto}_port_fallback": f"coalesce({value(proto + '_fallback')}, 0)", f"{proto}_evidence": value(f"{proto}_found")}
    return [f"{v} as {k}" for k, v in out.items()]


class _Evidence:
    """Reassembly of one flow, packet by packet, as streams need it; reassembled() says the same of a table."""

    def __init__(self):
        self.http, self.http_done, self.found = b"", None, (None, None, None)
        self.tls, self.tls_done, self.sni = b"", None, None

    def add(self, frame: int, sport: int, dport: int, payload: bytes) -> None:
        if self.http_done is None and (sport in HTTP_PORTS or dport in HTTP_PORTS):
            self.http = (self.http + payload)[-HTTP_BUFFER:]
            if b"\r\n\r\n" in self.http:
                self.found = http_head(self.http)
                if self.found[0]:
                    self.http_done, self.http = frame, b""
        if self.tls_done is None and dport == TLS_PORT:
            if self.tls or (len(payload) >= 6 and payload[0] == 0x16 and payload[5] == 1):
                self.tls += payload
            if len(self.tls) >= 5 and len(self.tls) >= 5 + int.from_bytes(self.tls[3:5], "big"):
                self.sni, self.tls_done, self.tls = server_name(self.tls), frame, b""

    def result(self):
        return (self.http_done, *(self.found if self.http_done else (None,) * 3), self.tls_done, self.sni)


def _with_found(state: DataFrame, evidence: DataFrame) -> DataFrame:
    """state with what reassembled() found of each flow.

    Keys meet as one value that is never NULL, so that no checks of their parts go down into the plan of the packets.
    """
    key = F.struct(*KEY)
    return state.withColumn("_key", key).join(evidence.withColumn("_key", key).drop(*KEY), "_key", "left").drop("_key")


def with_evidence(state: DataFrame, frame: str) -> DataFrame:
    """HTTP, TLS, SSH and SMB columns of flow state as of frame number `frame`."""
    c = F.col
    http, tls = F.coalesce(c("http_done") <= c(frame), F.lit(False)), F.coalesce((c("tls_done") <= c(frame)) & c("tls_sni").isNotNull(), F.lit(False))
    out = {}
    for name, proof in (("http", http), ("tls", tls)):
        by_port = c(f"{name}_port") == 1
        out |= {
            f"{name}_seen": (proof | by_port).cast("int"),
            f"{name}_payload_detected": proof.cast("int"),
            f"{name}_port_fallback": (~proof & by_port).cast("int"),
            f"{name}_detect_source": F.when(proof, "payload").when(by_port, "port").otherwise(""),
        }
    out |= {f"http_{x}": F.when(http, F.coalesce(c(f"http_{x}"), F.lit(""))).otherwise("") for x in ("method", "host", "path")}
    out["tls_sni"] = F.when(tls, c("tls_sni")).otherwise("")
    for name, evidence in (("ssh", "banner"), ("smb", "version")):
        out[f"{name}_detect_source"] = F.when(c(f"{name}_payload_detected") == 1, "payload").when(c(f"{name}_seen") == 1, "port").otherwise("")
        out[f"{name}_{evidence}"] = F.coalesce(c(f"{name}_evidence"), F.lit(""))
    state = state.withColumns(out)
    hint = (
        F.when(c("http_payload_detected") == 1, "http")
        .when((c("tls_sni") != "") | (c("tls_payload_detected") == 1), "tls")
        .when(c("http_port_fallback") == 1, "http")
        .when(c("tls_port_fallback") == 1, "tls")
        .when(c("ssh_seen") == 1, "ssh")
        .when(c("smb_seen") == 1, "smb")
        .otherwise("unknown")
    )
    return _in_seconds(state.withColumn("protocol_hint", hint))


def _in_seconds(state: DataFrame) -> DataFrame:
    """duration and iat_* of a flow's times in microseconds."""
    c = F.col
    seconds = {n: F.coalesce(c(f"{n}_us"), F.lit(0)) / F.lit(1e6) for n in ("duration", "iat_min", "iat_max")}
    average = F.when(c("pkts") > 1, c("duration_us") / F.lit(1e6) / (c("pkts") - 1)).otherwise(0.0)
    return state.withColumns({"iat_avg": average, **seconds})


def _named(df: DataFrame) -> DataFrame:
    names = {c.removeprefix("flow_") for c in FLOW_COLS} - {"src_ip", "dst_ip", "proto", "src_port", "dst_port"}
    return df.withColumnsRenamed({n: f"flow_{n}" for n in names if n in df.columns})


def flows(packets: DataFrame, width: int = SEGMENT) -> DataFrame:
    """The 56-column flow table, and first_frame_no."""
    keyed = with_proofs(packets).where("flow_proto is not null")
    sums = _segment_sums(_in_segments(keyed, width))
    whole = sums.groupBy("_flow").agg(*[F.expr(f"{_AGGREGATE[kind]}({name}) as {name}") for name, kind in KINDS.items()])
    state = whole.selectExpr(*[f"_flow.{k} as {k}" for k in KEY], *_measures())
    state = with_evidence(_with_found(state, reassembled(keyed, width)), "last_frame_no")
    return with_flow_risk(_named(state)).select(*FLOW_COLS, "first_frame_no")


def running(packets: DataFrame, width: int = SEGMENT, evidence: DataFrame | None = None) -> DataFrame:
    """Packets with the state of their flow up to and including them.

    Packets of no flow stay, each by itself, with an empty key.  evidence is
    reassembled() of the same packets, where the caller has it from a shorter plan.
    """
    keyed = with_proofs(packets).withColumn("_lone", F.when(F.col("flow_proto").isNull(), F.col("frame_no")))
    if evidence is None:
        evidence = reassembled(keyed.where("flow_proto is not null"), width)
    cut, columns = _in_segments(keyed, width), keyed.columns
    state = _state_of(cut, columns, tuple(KINDS), evidence)
    state = state.selectExpr(*[c for c in state.columns if c != "_state"], *_measures("_state."))
    return with_flow_risk(_named(with_evidence(state, "frame_no"))).drop("_lone")


def _state_of(cut: DataFrame, columns: list[str], names: tuple[str, ...], evidence: DataFrame | None = None) -> DataFrame:
    """columns of cut, the columns of evidence and `_state`, the named accumulators up to and including each packet."""
    before = "over (partition by _flow order by _segment rows between unbounded preceding and 1 preceding)"  # a row per segment
    carried = ", ".join(f"{_AGGREGATE[KINDS[n]]}({n}) {before} as {n}" for n in names)
    carry = _segment_sums(cut, names).selectExpr("_flow", "_segment", f"struct({carried}) as _before", *[f"_flow.{k} as {k}" for k in KEY])
    found = [c for c in evidence.columns if c not in KEY] if evidence is not None else []
    carry = (_with_found(carry, evidence) if found else carry).select("_flow", "_segment", "_before", *found)
    here = "over (partition by _flow, _segment order by frame_no rows between unbounded preceding and current row)"
    own = cut.selectExpr("*", *[f"{_gathered(n)} {here} as _own_{n}" for n in names])
    gap = "_own_start.value - _before.end.value"  # from the segment before to this one
    merged = {n: _merged(n, f"_before.{n}", f"_own_{n}", *([gap] if n.startswith("iat_") else [])) for n in names}
    return own.join(carry, ["_flow", "_segment"]).selectExpr(*columns, *found, f"struct({', '.join(f'{v} as {n}' for n, v in merged.items())}) as _state")


def running_sizes(packets: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Packets with flow_pkts, flow_bytes, flow_duration and flow_iat_* as running() has them; payloads are not looked at."""
    keyed = with_flow_key(packets).withColumn("_lone", F.when(F.col("flow_proto").isNull(), F.col("frame_no")))
    state = _state_of(_in_segments(keyed, width), keyed.columns, SIZES)
    sizes = [m for m in _measures("_state.") if m.rpartition(" as ")[2] in {*SIZES, "duration_us"}]
    return _named(_in_seconds(state.selectExpr(*keyed.columns, *sizes))).drop("_lone", "iat_min_us", "iat_max_us", "duration_us")


def times_between(packets: DataFrame, width: int = SEGMENT) -> DataFrame:
    """Packets of flows with their key and iat_us, the time since the flow's last packet; NULL for its first."""
    cut = _in_segments(with_flow_key(packets).where("flow_proto is not null"), width)
    ends = cut.groupBy("_flow", "_segment").agg(F.max(F.struct("frame_no", "ts_us")).alias("_end"))
    ends = ends.selectExpr("_flow", "_segment", "lag(_end.ts_us) over (partition by _flow order by _segment) as _last")
    whole = cut.join(ends, ["_flow", "_segment"])
    return whole.withColumn("iat_us", F.coalesce("iat_us", F.col("ts_us") - F.col("_last"))).drop("_flow", "_segment", "_last")
