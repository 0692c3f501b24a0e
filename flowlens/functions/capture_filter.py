"""Capture filters as predicates over packet columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.schema import FOCUS_PORTS


def any_port(*ports: int) -> Column:
    return F.col("sport").isin(*ports) | F.col("dport").isin(*ports)


def host(*ips: str) -> Column:
    return F.col("ip_src").isin(*ips) | F.col("ip_dst").isin(*ips)


def ip(version: int = 4) -> Column:
    return F.col("ip_version") == version


def protocol(name: str) -> Column:
    return F.col("l4_proto") == {"tcp": 6, "udp": 17}[name]


def default_filter() -> Column:
    """ip and tcp and (port 22 or port 80 or port 443 or port 445); NULL fields do not match."""
    return F.coalesce(ip(4) & protocol("tcp") & any_port(*FOCUS_PORTS), F.lit(False))
