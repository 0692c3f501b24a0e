"""Evidence in payload bytes: HTTP heads, SSH banners, SMB signatures, TLS server names, TCP options."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType

from flowlens.schema import HTTP_METHODS


def http_head(data: bytes) -> tuple[str | None, str | None, str | None]:
    """(method, host, path) of a request head, ("RESP", None, status line) of a response."""
    text = lambda x: x.decode("utf-8", "ignore")
    lines = data.partition(b"\r\n\r\n")[0].split(b"\r\n")
    first = lines[0].split(b" ")
    if text(first[0]) in HTTP_METHODS and first[0].isascii() and len(first) > 1:
        hosts = [x.partition(b":")[2].strip() for x in lines[1:] if x.lower().startswith(b"host:")]
        return text(first[0]), text(hosts[0]) if hosts else "", text(first[1])
    if lines[0].startswith(b"HTTP/"):
        return "RESP", None, text(lines[0])
    return None, None, None


def _utf8(data: Column) -> Column:
    """Bytes as text, those that are no UTF-8 left out."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def http_parse(payload: Column) -> Column:
    """struct(method, host, path) of a payload's HTTP head, in column expressions; NULL fields otherwise."""
    text = F.split(F.decode(payload, "ISO-8859-1"), "\r\n\r\n")[0]
    line = F.split(text, "\r\n")[0]
    is_request = F.rlike(line, F.lit("^(" + "|".join(HTTP_METHODS) + ") "))
    is_reply = F.startswith(line, F.lit("HTTP/"))
    host = F.regexp_extract(text, r"(?is)\r\nhost:(.*?)(?:\r\n|\z)", 1)
    host = F.regexp_replace(host, r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\z", "")
    read = lambda x: _utf8(F.encode(x, "ISO-8859-1"))
    return F.struct(
        F.when(is_request, F.split(line, " ")[0]).when(is_reply, "RESP").alias("method"),
        F.when(is_request, read(host)).alias("host"),
        F.when(is_request, read(F.split(line, " ")[1])).when(is_reply, read(line)).alias("path"),
    )


def ssh_banner(payload: Column) -> Column:
    """First line of a payload that starts with SSH-, at most 255 characters; else NULL."""
    text = F.regexp_replace(_utf8(payload), r"^\s+|\s+$", "")
    line = F.split(text, r"\r\n|\r|\n")[0]
    return F.when(F.startswith(text, F.lit("SSH-")) & (F.length(line) <= 255), line)


def smb_version(payload: Column) -> Column:
    head = F.substring(payload, 1, 128)
    return F.when(F.contains(head, F.lit(b"\xfeSMB")), "SMB2/3").when(F.contains(head, F.lit(b"\xffSMB")), "SMB1")


def server_name(data: bytes | None) -> str | None:
    """SNI of a ClientHello that lies whole in one TLS record; None on any bound overrun."""
    if not data or len(data) < 5 or data[0] != 0x16:
        return None
    record = data[5 : 5 + int.from_bytes(data[3:5], "big")]
    if len(record) < int.from_bytes(data[3:5], "big") or len(record) < 4 or record[0] != 1:
        return None
    size = int.from_bytes(record[1:4], "big")
    hello = record[4 : 4 + size]
    if len(hello) < size:
        return None
    at = 34  # version and random
    for width in (1, 2, 1):  # session id, ciphers, compression
        if at + width > len(hello):
            return None
        at += width + int.from_bytes(hello[at : at + width], "big")
    if at + 2 > len(hello):
        return None
    stop = at + 2 + int.from_bytes(hello[at : at + 2], "big")
    at += 2
    if stop > len(hello):
        return None
    while at + 4 <= stop:
        kind, n = int.from_bytes(hello[at : at + 2], "big"), int.from_bytes(hello[at + 2 : at + 4], "big")
        body = hello[at + 4 : at + 4 + n]
        if at + 4 + n > stop:
            return None
        if kind == 0:
            names, place = body[2 : 2 + int.from_bytes(body[:2], "big")], 0
            while n >= 5 and place + 3 <= len(names):
                size = int.from_bytes(names[place + 1 : place + 3], "big")
                name = names[place + 3 : place + 3 + size]
                if len(name) < size:
                    return None
                if names[place] == 0:
                    return name.decode("ascii", "ignore")
                place += 3 + size
            return None
        at += 4 + n
    return None


@F.pandas_udf(StringType())
def tls_sni(payload: pd.Series) -> pd.Series:
    """server_name() by Arrow batches."""
    return payload.map(server_name, na_action="ignore")


@F.pandas_udf(MapType(StringType(), LongType()))
def tcp_options(options: pd.Series) -> pd.Series:
    """MSS, WScale, SAckOK, Timestamp and TimestampEcho of TCP option bytes."""

    def one(data):
        out, at = {}, 0
        while data is not None and at < len(data) and data[at] != 0:
            if data[at] == 1:
                at += 1
                continue
            if at + 1 >= len(data) or data[at + 1] < 2:
                break
            kind, body = data[at], data[at + 2 : at + data[at + 1]]
            if kind in (2, 3):
                out["MSS" if kind == 2 else "WScale"] = int.from_bytes(body, "big")
            elif kind == 4:
                out["SAckOK"] = 1
            elif kind == 8:
                out["Timestamp"], out["TimestampEcho"] = (int.from_bytes(body[a : a + 4], "big") for a in (0, 4))
            at += data[at + 1]
        return out

    return options.map(one)
