"""Payload evidence over packet borders: the frame that completes a flow's HTTP head or ClientHello, and what it says.

A flow's payload packets are streams of bytes: those of HTTP ports in both
directions, and those to the TLS port.  Where things stand in a stream is found
without moving payloads: a packet sends its size, its first and last bytes and
what it holds whole; borders are looked at with the last bytes that came before.
Streams are cut into segments of frame numbers as flow state is.  Only packets
of the completing window, at most 4096 bytes of HTTP or one record of TLS, are
put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.payload import http_parse, tls_sni
from flowlens.operators.flowkey import KEY
from flowlens.schema import HTTP_BUFFER, HTTP_METHODS, HTTP_PORTS, TLS_PORT

#: What a head starts with; the longest is of 8 bytes, so 7 are carried over borders.
_HEADS = "|".join([*(f"{m} " for m in HTTP_METHODS), "HTTP/"])
_CARRIED = 7
#: Parts that the packets of one stream are dealt to, by segment, where payloads are fetched.
_DEALT = 64


def _last_cut(text: str) -> str:
    """SQL of the place, from 0, of the last empty line (CR LF CR LF) in a text; NULL if none."""
    return f"if(contains({text}, '\\r\\n\\r\\n'), length({text}) - 3 - locate('\\n\\r\\n\\r', reverse({text})), null)"


def _places(text: str) -> str:
    """SQL of the places, from 0, where a head may start in a text."""
    step = f"named_struct('at', a.at + length(x), 'found', if(rlike(x, '^(?:{_HEADS})'), array_append(a.found, a.at), a.found))"
    zero = "named_struct('at', 0, 'found', cast(array() as array<int>))"
    return f"if(rlike({text}, '{_HEADS}'), aggregate(split({text}, '(?={_HEADS})'), {zero}, (a, x) -> {step}).found, null)"


def _streams(facts: DataFrame, width: int) -> DataFrame:
    """_stream, _segment, frame_no and payload of packets that may bear evidence."""
    ports = ", ".join(map(str, HTTP_PORTS))
    kinds = f"array_compact(array(if(sport in ({ports}) or dport in ({ports}), 'http', null), if(dport = {TLS_PORT}, 'tls', null)))"
    rows = facts.where("l4_proto = 6 and length(payload) > 0").selectExpr(*KEY, "frame_no", "payload", f"explode({kinds}) as _kind")
    return rows.selectExpr(f"struct({', '.join(KEY)}, _kind) as _stream", f"frame_no div {width} as _segment", "frame_no", "payload")


def _placed(streams: DataFrame) -> DataFrame:
    """Packets without payload, by where they end in their segment of the stream, with the segment's carry."""
    text, http = "decode(payload, 'ISO-8859-1')", "_stream._kind = 'http'"
    hello = "_stream._kind = 'tls' and length(payload) >= 6 and hex(substring(payload, 1, 1)) = '16' and hex(substring(payload, 6, 1)) = '01'"
    narrow = streams.selectExpr(
        "_stream", "_segment", "frame_no", "cast(length(payload) as bigint) as _size",
        f"decode(substring(payload, 1, {_CARRIED}), 'ISO-8859-1') as _head", f"decode(substring(payload, -{_CARRIED}), 'ISO-8859-1') as _tail",
        # One column, so that both readings of this table (sums of segments, packets) are one shuffle.
        f"if({http}, concat(array({_last_cut(text)}), coalesce({_places(text)}, cast(array() as array<int>))), null) as _inner",
        f"if({hello}, 5 + cast(conv(hex(substring(payload, 4, 2)), 16, 10) as bigint), null) as _record",
    )
    here = "over (partition by _stream, _segment order by frame_no rows between"
    seen = narrow.selectExpr(
        "*",
        f"array_join(collect_list(_tail) {here} {_CARRIED} preceding and 1 preceding), '') as _lead",
        f"array_join(collect_list(_head) {here} current row and {_CARRIED} following), '') as _ahead",
        f"min(frame_no) {here} {_CARRIED} preceding and current row) as _back",
        f"count(*) {here} unbounded preceding and current row) as _nth",
        f"sum(_size) {here} unbounded preceding and current row) as _end",
    )
    border = "concat(right(_lead, 3), left(_head, 3))"
    cut = f"greatest(_end - _size + get(_inner, 0), _end - _size - length(right(_lead, 3)) + {_last_cut(border)})"
    own = seen.selectExpr(
        "*",
        f"max(if({http}, {cut}, null)) {here} unbounded preceding and current row) as _cut",
        f"min(if(_record is null, null, struct(frame_no as first, _end - _size + _record as goal))) {here} unbounded preceding and current row) as _hello",
    )
    sums = own.groupBy("_stream", "_segment").agg(
        *[F.expr(x) for x in (
            "sum(_size) as size", "max(_cut) as cut", "min(_hello) as hello", "min_by(_ahead, frame_no) as ahead",
            f"max_by(right(concat(_lead, _tail), {_CARRIED}), frame_no) as tail", "max_by(_back, frame_no) as back",
        )]
    )
    # A row per segment of a stream.
    before = "over (partition by _stream order by _segment rows between"
    sums = sums.selectExpr(
        "*",
        f"coalesce(sum(size) {before} unbounded preceding and 1 preceding), 0L) as base",
        f"right(array_join(collect_list(tail) {before} {_CARRIED} preceding and 1 preceding), ''), {_CARRIED}) as lead",
        f"min(back) {before} {_CARRIED} preceding and 1 preceding) as lead_back",
    )
    border = "concat(right(lead, 3), left(ahead, 3))"
    sums = sums.selectExpr("*", f"base - length(right(lead, 3)) + {_last_cut(border)} as crossing")
    carry = sums.selectExpr(
        "_stream", "_segment", "base", "lead", "lead_back", "crossing",
        f"max(greatest(base + cut, crossing)) {before} unbounded preceding and 1 preceding) as cut_before",
        f"min(if(hello is null, null, struct(hello.first as first, base + hello.goal as goal))) {before} unbounded preceding and 1 preceding) as hello_before",
    )
    return own.join(carry, ["_stream", "_segment"]).selectExpr(
        "_stream", "frame_no", "base + _end - _size as start", "base + _end as end", "_head", "slice(_inner, 2, size(_inner) - 1) as _inner_places",
        f"right(concat(lead, _lead), {_CARRIED}) as lead",
        f"if(_nth <= {_CARRIED}, least(_back, lead_back), _back) as back",
        "greatest(base + _cut, cut_before, if(base + _end >= crossing + 4, crossing, null)) as cut",
        "coalesce(hello_before, if(_hello is null, null, struct(_hello.first as first, base + _hello.goal as goal))) as hello",
    )


def _completed(placed: DataFrame) -> DataFrame:
    """_stream, done, first: the frame that completes a stream's evidence, and one at or soon before its window's start.

    HTTP is complete with the first packet at whose end the last 4096 bytes of the
    stream have an empty line and start as a head does; so starts and ends meet by place.
    """
    start_of = f"greatest(end - {HTTP_BUFFER}, 0L)"
    over = f"filter(sequence(0, {_CARRIED - 1}), i -> i < length(lead) and rlike(substring(concat(lead, _head), i + 1, {_CARRIED + 1}), '^(?:{_HEADS})'))"
    row = "named_struct('place', {0}, 'done', cast({1} as bigint), 'first', cast({2} as bigint))"
    starts = f"transform(coalesce(_inner_places, cast(array() as array<int>)), i -> {row.format('start + i', 'null', 'back')})"
    starts_over = f"transform({over}, i -> {row.format('start - length(lead) + i', 'null', 'back')})"
    ends = f"if(cut >= {start_of}, array({row.format(start_of, 'frame_no', 'null')}), array())"
    http = f"concat({starts}, {starts_over}, {ends})"
    tls = f"if(hello.goal > start and hello.goal <= end, array({row.format('0L', 'frame_no', 'hello.first')}), array())"
    events = placed.selectExpr("_stream", f"explode(if(_stream._kind = 'http', {http}, {tls})) as e")
    met = events.groupBy("_stream", "e.place").agg(F.min("e.done").alias("done"), F.min("e.first").alias("first"))
    met = met.where("done is not null and first is not null")
    return met.groupBy("_stream").agg(F.min(F.struct("done", "first")).alias("_w")).select("_stream", "_w.*")


def reassembled(facts: DataFrame, width: int) -> DataFrame:
    """key, http_done, http_method, http_host, http_path, tls_done, tls_sni: flows whose payload was understood.

    Packets count in order of arrival.  done is the frame that completed the
    evidence.  width is the number of frames of a segment, the most that a task
    needs to hold of one flow; any gives the same.
    """
    streams = _streams(facts, width)
    part = lambda segment: f"pmod({segment}, {_DEALT}L)"
    first, last = f"first div {width}", f"done div {width}"
    windows = _completed(_placed(streams)).selectExpr("*", f"explode(transform(sequence({first}, least({last}, {first} + {_DEALT - 1})), s -> {part('s')})) as _part")
    payloads = streams.selectExpr("_stream", f"{part('_segment')} as _part", "frame_no", "payload")
    inside = payloads.join(windows, ["_stream", "_part"]).where("frame_no between first and done")
    http = "_stream._kind = 'http'"
    data = f"decode(if({http}, substring(payload, -{HTTP_BUFFER}), payload), 'ISO-8859-1')"
    whole = inside.groupBy("_stream", "done").agg(F.expr(f"array_sort(collect_list(struct(frame_no, {data} as data)))").alias("_packets"))
    whole = whole.selectExpr("_stream", "done", "array_join(transform(_packets, x -> x.data), '') as _text")
    whole = whole.selectExpr("_stream", "done", f"encode(if({http}, right(_text, {HTTP_BUFFER}), _text), 'ISO-8859-1') as _bytes")
    kind = F.col("_stream._kind")
    key = F.struct(*[f"_stream.{k}" for k in KEY]).alias("_flow")
    read = whole.select(key, kind.alias("_kind"), "done", F.when(kind == "http", http_parse(F.col("_bytes"))).alias("_http"), tls_sni(F.when(kind == "tls", F.col("_bytes"))).alias("_sni"))
    of = lambda which, value, name: F.max(F.when(F.col("_kind") == which, F.col(value))).alias(name)
    found = read.groupBy("_flow").agg(
        of("http", "done", "http_done"), *[of("http", f"_http.{x}", f"http_{x}") for x in ("method", "host", "path")],
        of("tls", "done", "tls_done"), of("tls", "_sni", "tls_sni"),
    )
    return found.select("_flow.*", *[c for c in found.columns if c != "_flow"])
