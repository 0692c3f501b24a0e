"""The packet view of the events table: every event is a packet between a client
and a server, with header fields, flags, checksums and some payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.header import bound
from flowlens.sources.shared import compiled_methods

#: Header columns in SQL that Spark and DuckDB share; {us} is ts in microseconds, {S} the string type.
PACKET_SQL = """
select frame_no, user_id, k, h, rev, udp, sp,
 case when h=3 then 1704067200000000 + frame_no*10 else us end as ts_us,
 case when rev=1 then srv else cli end as ip_src, case when rev=1 then cli else srv end as ip_dst,
 case when rev=1 then '02:00:00:00:01:' || cast(10+user_id%3 as {S}) else '02:00:00:00:00:' || cast(10+user_id%25 as {S}) end as eth_src,
 case when rev=1 then sp else 40000+h end as sport, case when rev=1 then 40000+h else sp end as dport,
 case when udp=1 then 17 else 6 end as ip_proto, cast(54+floor(value) as bigint) as len_bytes,
 case when udp=1 then '' when h=7 then 'S' when k%8=0 then 'S' when k%8=1 then 'SA' when k%8=2 then 'A' when k%8=3 then 'PA'
      when k%8=4 then 'FA' when k%8=5 then 'R' when k%8=6 then 'A' else 'FS' end as tcp_flags,
 case when k%17=0 then 10 else 64 end as ttl_hlim, case when k%19=0 then 10 else 0 end as dscp,
 case when k%29=0 then 1 else 0 end as ip_flags_mf, 0 as ip_frag_off,
 case when k%31=0 then 0 else 1 end as ipv4_checksum_ok, case when k%11=0 then 0 else 1 end as l4_checksum_ok,
 4 as ip_version, case when k%19=0 then 40 else 0 end as ip_tos, 0 as ecn, cast(40+floor(value) as bigint) as ip_total_len,
 frame_no%65536 as ip_id, 0 as ip_flags_df, (k*7919)%65536 as ip_hdr_checksum, 20 as ip_ihl_bytes,
 case when udp=1 then 17 else 6 end as l4_proto, case when udp=0 then 8192+k%1000 end as tcp_win, case when udp=0 then 20 end as tcp_hdr_len,
 '02:00:00:00:ff:01' as eth_dst, '0x0800' as eth_type, case when k%41=0 then 100 end as vlan_id, case when k%41=0 then 3 end as vlan_prio,
 case when udp=0 and rev=0 and h<>7 and k%8=3 then
   case when sp=80 and k%16=3 then 'http' when sp=8080 and k%16=3 then 'reply' when sp=22 and k%16=3 then 'ssh'
        when sp=445 and k%16=3 then 'smb2' when sp=445 and k%48=11 then 'smb1' when sp=443 and k%16=3 then 'tls' when sp=443 and k%48=11 then 'tls0' end end as evidence
from (select *, case when k%5=4 and h not in (7,9) then 1 else 0 end as rev, case when k%37=5 and h<>7 then 1 else 0 end as udp,
        '10.0.0.' || cast(h as {S}) as cli, '10.0.1.' || cast(user_id%3 as {S}) as srv
      from (select event_id+1 as frame_no, {us} as us, user_id, user_id%20 as h, value, event_type,
              cast(regexp_extract(props,'([0-9]+)',1) as int) as k,
              case event_type when 'view' then 80 when 'click' then 443 when 'purchase' then 22 when 'error' then 445 else 8080 end as sp
            from events) e0) e1
"""


def client_hello(name):
    """TLS record with a ClientHello whose server name is `name`, an ASCII column."""
    n = F.length(name)
    zeros = "00" * 32
    head = F.format_string(f"160301%04x01%06x0303{zeros}000002130101%s%04x001700000000%04x%04x00%04x", n + 60, n + 56, F.lit("00"), n + 13, n + 5, n + 3, n)
    return F.concat(F.unhex(head), F.encode(name, "ISO-8859-1"))


#: The same without a server name.
NAMELESS_HELLO = bytes.fromhex("16030100330100002f0303" + "00" * 32 + "00000213010100000400170000")


def payload():
    """Payload bytes of the packet view's evidence; empty without."""
    text = lambda c: F.encode(c, "ISO-8859-1")
    user, k = F.col("user_id").cast("string"), F.col("k").cast("string")
    request = F.concat(F.lit("GET /p"), k, F.lit(" HTTP/1.1\r\nUser-Agent: x\r\nHost: h"), user, F.lit(".example\r\n\r\n"))
    # Bound, as the text of evidence would stand in every branch.
    return bound(
        F.col("evidence"),
        lambda kind: F.when(kind == "http", text(request))
        .when(kind == "reply", F.lit(b"HTTP/1.1 200 OK\r\n\r\n"))
        .when(kind == "ssh", text(F.concat(F.lit("SSH-2.0-srv_"), k, F.lit("\r\n"))))
        .when(kind == "smb2", F.lit(b"\x00\x00\x00\x2a\xfeSMB"))
        .when(kind == "smb1", F.lit(b"\xffSMB"))
        .when(kind == "tls", client_hello(F.concat(F.lit("s"), user, F.lit(".example"))))
        .when(kind == "tls0", F.lit(NAMELESS_HELLO))
        .otherwise(F.lit(b"")),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    compiled_methods(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    sql = PACKET_SQL.format(us="unix_micros(ts)", S="string").replace("from events)", "from {events})")
    return spark.sql(sql, events=events).withColumn("payload", payload())
