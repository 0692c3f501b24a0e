"""Flow state over a stream of packets: the batch's accumulators, kept per flow between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.operators import flows
from flowlens.operators.flowkey import KEY
from flowlens.operators.rules import with_flow_risk
from flowlens.schema import FEATURE_COLS, FLOW_COLS, SSH_SMB

_LISTED = {kind: [n for n, k in flows.KINDS.items() if k == kind] for kind in ("sum", "least", "greatest", "first", "last")}
_TEXTS = ["ssh_found", "smb_found"]
_EVIDENCE = {"http_done": "long", "http_method": "string", "http_host": "string", "http_path": "string", "tls_done": "long", "tls_sni": "string"}


def _type(name: str) -> str:
    if name in _TEXTS:
        return "string"
    return "int" if name.endswith(("_seen", "_port", "_detected", "_fallback", "_low", "_high")) else "long"


_GATHERED = {n: _type(n) for n in flows.KINDS}
_KEY = "flow_src_ip string, flow_dst_ip string, flow_proto int, flow_src_port int, flow_dst_port int"
_OUT = f"{_KEY}, frame_no long, " + ", ".join(f"{n} {t}" for n, t in (_GATHERED | _EVIDENCE).items())
_STATE = ", ".join(f"{n} {t}" for n, t in (_GATHERED | _EVIDENCE).items()) + ", http_bytes binary"


class FlowProcessor(StatefulProcessor):
    """Packets of a flow in order of arrival, each with the flow's state up to it, or with `latest` only the last.

    What is kept of a flow: its accumulators, the last bytes of HTTP, and the
    parts of a ClientHello that is not whole yet, as a list.  A flow that says
    nothing for idle_ms starts anew.
    """

    def __init__(self, latest: bool = False, idle_ms: int | None = None):
        self.latest, self.idle_ms = latest, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", _STATE)
        self.hello = handle.getListState("hello", "part binary")

    def _evidence(self, kept: dict) -> flows._Evidence:
        e = flows._Evidence()
        e.http, e.http_done, e.tls_done, e.sni = bytes(kept.get("http_bytes") or b""), kept.get("http_done"), kept.get("tls_done"), kept.get("tls_sni")
        e.found = tuple(kept.get(f"http_{x}") for x in ("method", "host", "path"))
        if kept and e.tls_done is None:
            e.tls = b"".join(bytes(part) for (part,) in self.hello.get())
        return e

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packets = pd.concat(list(rows)).sort_values("frame_no", ignore_index=True)
        kept = dict(zip([*_GATHERED, *_EVIDENCE, "http_bytes"], self.state.get(), strict=True)) if self.state.exists() else {}
        out = gathered(packets, kept)
        self._fold(packets, kept, out)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if self.latest:
            out = out.tail(1)
        for at, (name, value) in enumerate(zip(KEY, key, strict=True)):
            out.insert(at, name, value)
        yield out

    def _fold(self, packets: pd.DataFrame, kept: dict, out: pd.DataFrame) -> None:
        """Evidence columns of out, and the state that is kept; only packets with payload are looked at."""
        e, was = self._evidence(kept), len(packets)
        found = np.empty((was, len(_EVIDENCE)), object)
        found[:] = (e.http_done, *(e.found if e.http_done is not None else (None,) * 3), e.tls_done, e.sni)
        held = len(e.tls)
        for i in np.flatnonzero(packets["payload"].notna()):
            before = (e.http_done, e.tls_done)
            e.add(*(int(packets[c].iat[i]) for c in ("frame_no", "sport", "dport")), bytes(packets["payload"].iat[i]))
            if (e.http_done, e.tls_done) != before:
                found[i:] = e.result()
        for k, (name, kind) in enumerate(_EVIDENCE.items()):
            out[name] = pd.array(found[:, k], "Int64") if kind == "long" else found[:, k]
        if len(e.tls) < held:
            self.hello.clear()
        elif len(e.tls) > held:
            self.hello.appendValue((e.tls[held:],))
        last = out.iloc[-1]
        plain = [None if pd.isna(last[n]) else last[n] if t == "string" else int(last[n]) for n, t in (_GATHERED | _EVIDENCE).items()]
        self.state.update((*plain, b"" if e.http_done is not None else e.http))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        self.hello.clear()
        return iter([])

    def close(self) -> None:
        pass


def gathered(packets: pd.DataFrame, kept: dict) -> pd.DataFrame:
    """frame_no and the accumulators up to each packet; kept is what was there before."""
    out = {"frame_no": packets["frame_no"]}
    ts = packets["in_end"].to_numpy(float)
    iat = np.diff(ts, prepend=np.nan if kept.get("end") is None else kept["end"])
    columns = {n: iat if n.startswith("iat_") else packets[f"in_{n}"] for n in flows.KINDS}
    for kind, step, none in (("sum", np.add, 0), ("least", np.fmin, np.nan), ("greatest", np.fmax, np.nan)):
        names = _LISTED[kind]
        values = np.column_stack([np.asarray(columns[n], float) for n in names])  # whole numbers below 2^53
        base = np.array([[none if kept.get(n) is None else kept[n] for n in names]], float)
        so_far = step.accumulate(np.concatenate([base, values]))[1:]
        out |= dict(zip(names, so_far.T, strict=True))
    for n in _LISTED["last"] + _LISTED["first"]:
        values = np.append(columns[n].to_numpy(object), kept.get(n))  # what was there before stands at -1
        known = ~pd.isna(values)
        if n in _LISTED["last"]:
            at = np.maximum.accumulate(np.where(known[:-1], np.arange(len(packets)), -1))
        else:
            first = -1 if known[-1] else int(np.argmax(known)) if known.any() else len(packets)
            at = np.where(np.arange(len(packets)) >= first, first, -1)
        so_far = values[at]
        so_far[~known[at]] = None
        out[n] = so_far
    table = pd.DataFrame(out)
    for n, kind in _GATHERED.items():
        if kind != "string":
            table[n] = pd.to_numeric(table[n]).astype("Int64")
    return table


def _inputs(packets: DataFrame) -> DataFrame:
    """Key and what a packet adds to each accumulator; payload where it may be evidence."""
    keyed = flows.with_proofs(packets).where("flow_proto is not null")
    values = {n: v for n, (_, v) in flows.accumulators().items() if not n.startswith("iat_")}
    wanted = f"l4_proto = 6 and length(payload) > 0 and ({flows._either_sql(*flows.HTTP_PORTS)} or dport = {flows.TLS_PORT})"
    types = {"string": "string", "int": "int", "long": "bigint"}
    ints = [f"cast({k} as int) as {k}" if k.endswith(("proto", "port")) else k for k in KEY]
    return keyed.selectExpr(*ints, "frame_no", "cast(sport as int) as sport", "cast(dport as int) as dport", f"if({wanted}, payload, null) as payload", *[f"cast({v} as {types[_GATHERED[n]]}) as in_{n}" for n, v in values.items()])


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _stated(packets: DataFrame, latest: bool, idle_ms: int | None) -> DataFrame:
    keep_state_in_rocksdb(packets.sparkSession)
    out = _inputs(packets).groupBy(*KEY).transformWithStateInPandas(FlowProcessor(latest, idle_ms), _OUT, "Update" if latest else "Append", "None" if idle_ms is None else "ProcessingTime")
    state = out.selectExpr(*KEY, "frame_no", *_EVIDENCE, *flows._measures(placed=False))
    return with_flow_risk(flows._named(flows.with_evidence(state, "frame_no")))


def running_features(packets: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Of a stream of packets of flows: frame_no, key and all flow columns of the feature table, appended as packets come.

    State is kept per flow for good, as a capture does; with idle_ms, a flow
    silent for so long starts anew.  Packets are taken in order of frame_no inside
    a micro-batch, whose size bounds what a task holds of a flow; those of later
    micro-batches come after them.  Null payloads are empty.
    """
    return _stated(packets, False, idle_ms).select("frame_no", *KEY, *[c for c in FEATURE_COLS if c.startswith("flow_")], *SSH_SMB)


def updated_flows(packets: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Of a stream of packets: the flow table's row of each flow that a micro-batch has changed, in update mode."""
    return _stated(packets, True, idle_ms).select(*FLOW_COLS, "first_frame_no", F.col("frame_no").alias("last_frame_no"))
