"""Evidence over packet borders: the table says what a fold packet by packet says, whatever the cuts."""

import random

import pytest
from flowlens.functions import payload
from flowlens.operators import flows
from flowlens.operators.reassembly import reassembled
from flowlens.plans.packets import NAMELESS_HELLO
from pyspark.sql import functions as F

SCHEMA = "flow_src_ip string, flow_dst_ip string, flow_proto int, flow_src_port int, flow_dst_port int, frame_no long, sport int, dport int, l4_proto int, payload binary"


def _hello(name: bytes) -> bytes:
    n = len(name)
    ext = b"\x00\x00" + (n + 5).to_bytes(2, "big") + (n + 3).to_bytes(2, "big") + b"\x00" + n.to_bytes(2, "big") + name
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + len(ext).to_bytes(2, "big") + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + len(shake).to_bytes(2, "big") + shake


def _pieces(rng, data: bytes, sizes) -> list[bytes]:
    out = []
    while data:
        n = rng.choice(sizes)
        out.append(data[:n])
        data = data[n:]
    return out


def _streams(rng):
    """(port, packets) of flows: heads and hellos in pieces, late, never whole, after other bytes, beyond the window."""
    head = b"GET /a HTTP/1.1\r\nX: y\r\nHost: h\xe9.example \r\n\r\n"
    junk = lambda n: bytes(rng.choice(b"ab \r\nGETHP/\xff") for _ in range(n))
    small, large = [1, 2, 3, 5], [1, 40, 700, 1460, 5000]
    for sizes in (small, large):
        yield 80, _pieces(rng, head + b"body", sizes)
        yield 8080, _pieces(rng, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + head, sizes)
        yield 80, _pieces(rng, b"x\r\n\r\n" + head, sizes)
        yield 80, _pieces(rng, head[:-2], sizes)
        yield 443, _pieces(rng, _hello(b"name.example") + b"more", sizes)
        yield 443, _pieces(rng, _hello(b"n" * 200)[:-1], sizes)
        yield 443, [b"\x17\x03\x01\x00\x01x", *_pieces(rng, _hello(b"late.example"), [7, 50]), _hello(b"second.example")]
    for shift in (0, 1, 5):  # the window starts as a head does only where a packet ends 4096 bytes on
        yield 80, _pieces(rng, junk(3000) + head + bytes(4096 - len(head)), [500 + shift, 1000 + shift]) + [b"z"] * 40
        late = b"j" * 2500 + head + b"p" * (4096 - len(head))
        yield 80, [late[:2500 - shift], late[2500 - shift : 2503], late[2503:-1000], late[-1000:], b"end"]
    yield 80, [b"POST /" + b"q" * 5000 + b" HTTP/1.1\r\n\r\n", b"GET / HTTP/1.0\r\n\r\n"]
    yield 443, [NAMELESS_HELLO, _hello(b"x.example")]
    yield 443, [b"\x16\x03\x01", b"\x16\x03\x01\xff\xff\x01" + bytes(100), *[bytes(1400)] * 60]
    for _ in range(30):
        yield rng.choice([80, 443, 22]), [rng.choice([b"", None, head[:9], head[9:], head, junk(30), b"\r\n", b"\r", b"\n", _hello(b"r.example")]) for _ in range(rng.randrange(1, 12))]
    for _ in range(10):
        yield 8000, _pieces(rng, junk(4000) + b"PUT /r HTTP/1.1\r\n" + junk(3000) + b"\r\n\r\n" + junk(3000), [300, 4096, 1024])


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    pending, want, rows = {}, {}, []
    for k, (port, packets) in enumerate(_streams(rng)):
        pending[k] = [(port, p) for p in packets]
        want[k] = flows._Evidence()
    frame = 0
    while pending:  # flows in turn, so that every one spans many segments
        k = rng.choice(list(pending))
        frame += rng.randrange(1, 4)
        port, data = pending[k].pop(0)
        if not pending[k]:
            del pending[k]
        ends = (50000 + k, port) if port == 443 or rng.random() < 0.7 else (port, 50000 + k)
        rows.append(("1.1.1.1", "2.2.2.2", 6, port, 50000 + k, frame, *ends, 6, data))
        if data:
            want[k].add(frame, *ends, data)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).cache(), {k: e.result() for k, e in want.items()}


@pytest.mark.parametrize("width", [1, 13, 400, 1 << 18])
def test_table_is_the_fold(case, width):
    df, want = case
    got = {r.flow_dst_port - 50000: tuple(r)[5:] for r in reassembled(df, width).collect()}
    none = (None,) * 6
    plain = lambda e: (*e[:5], e[5]) if e[0] or e[4] else none
    assert {k: got.get(k, none) for k in want} == {k: plain(e) for k, e in want.items()}
    assert sum(e[0] is not None for e in want.values()) > 8 and sum(e[5] is not None for e in want.values()) > 4


def test_no_payload_no_rows(case):
    df, _ = case
    assert reassembled(df.limit(0), 10).count() == 0
    assert reassembled(df.withColumn("payload", F.lit(None).cast("binary")), 10).count() == 0
    assert reassembled(df.withColumn("l4_proto", F.lit(17)), 10).count() == 0


def test_one_stream_is_spread(spark):
    """A flow with all packets: no segment of it is larger than the width, and its head is found in the last."""
    rows = [("1.1.1.1", "2.2.2.2", 6, 80, 50000, k, 50000, 80, 6, b"noise %05d" % k if k < 3990 else b"\r\n\r\n") for k in range(4000)]
    at = 3990 * 11 + 4 - 4096  # of the first frame with an empty line
    data = bytearray(b"".join(r[-1] for r in rows))
    data[at : at + 4] = b"GET "
    at, cut = 0, []
    for r in rows:
        cut.append((*r[:-1], bytes(data[at : at + len(r[-1])])))
        at += len(r[-1])
    e = flows._Evidence()
    for r in cut:
        e.add(*r[5:8], r[-1])
    df = spark.createDataFrame(cut, SCHEMA)
    assert [tuple(r)[5:] for r in reassembled(df, 64).collect()] == [e.result()]
    assert e.http_done == 3990


@pytest.mark.parametrize("head", [b"GET / HTTP/1.1\r\nHost:\r\nNext: x\r\n\r\n", b"GET / HTTP/1.1\r\nA: b\r\nHOST:\t h h \r\nHost: g\r\n\r\n", b"GET  /two HTTP\r\nHost: \x0bx\x0c", b"HEAD /\r\nHost:x\r\n\r\nHost: body"])
def test_heads_as_columns(spark, head):
    assert tuple(spark.range(1).select(payload.http_parse(F.lit(head)).alias("h")).first().h) == payload.http_head(head)
