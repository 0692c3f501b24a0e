"""The capture log: records of several lines for packets, one line for each flow, written and read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.operators.dashboard import flow_lines, frame_lines
from flowlens.sources.shared import partitions, written
from flowlens.sources.tables import joined_to_blocks, with_blocks

SUMMARY = "=== Flow summary ==="
#: Lines of a piece, the most that a task must hold to carry a record's beginning on, as a power of two.
PIECE_BITS = 16
#: Pieces of a partition, about.
PIECES = 4
_OF = ["file", "block", "_task", "_piece"]


def write_log(packets: DataFrame, flows: DataFrame, path: str, preview: int | None = 32) -> None:
    """Packets by ranges of frame_no, an empty line ahead of each record, then flows; old files are replaced."""
    n = partitions(packets.sparkSession)
    # Dealt as packets: the bounds of ranges take a reading of their own, which would render every line as well.
    records = frame_lines(packets.repartitionByRange(n, "frame_no").sortWithinPartitions("frame_no"), preview)
    records.select(F.concat(F.lit("\n"), F.col("line"))).write.mode("overwrite").text(f"{path}/packets")
    lines = flow_lines(flows).repartitionByRange(n, "first_frame_no").sortWithinPartitions("first_frame_no")
    lines.select("line").write.mode("overwrite").text(f"{path}/flows")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, record, line: the lines of a log's files, bytes that are no UTF-8 replaced, each with its record, numbered
    by the place of its first line.  record is NULL for lines ahead of all records and for those of the flow summary.

    A record may reach over the borders of splits: within a piece of PIECE lines of a block the last beginning is
    carried on, and the last one of a piece, a row each, to the pieces behind it.  So a task need not hold a block.
    """
    return _lines(spark, path)[0].select("file", "record", "line")


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """log_lines() with the columns _OF that name a line's piece, dealt by these to a number of partitions that grows with the log, and that number."""
    text = with_blocks(spark.read.option("recursiveFileLookup", True).text(path)).withColumn("line", F.make_valid_utf8("value")).drop("value")
    text = text.withColumn("_piece", F.shiftright("_id", PIECE_BITS))
    begins = F.when(F.col("line").rlike("^=== (Frame -?\\d+|Flow summary) ===$"), F.struct("block", F.col("_id").alias("at"), (F.col("line") != SUMMARY).alias("packet")))
    text = text.withColumn("_begins", begins)
    ends = text.groupBy("file", "block", "_task", "_piece").agg(F.max("_begins").alias("_ends"))
    ahead = Window.partitionBy("file").orderBy("block", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(ends.withColumn("_ahead", F.max("_ends").over(ahead)).drop("_ends"), "blocks")
    parts = max(partitions(spark), -(-blocks.count() // PIECES))
    so_far = Window.partitionBy(*_OF).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.max("_begins").over(so_far), F.col("_ahead"))
    out = joined_to_blocks(text, blocks, "_piece").where("_found").drop("_found").repartition(parts, *_OF).withColumn("_last", last)
    return out.select(*_OF, F.when(F.col("_last.packet"), F.struct("_last.block", "_last.at")).alias("record"), "line"), parts


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """A row per packet of a log, with what its lines say; what they do not say is NULL.

    A piece's lines are gathered where they are; only a row per record goes on, to meet what the piece behind it has.
    """
    lines, parts = _lines(spark, path)
    lines = lines.where("record is not null")
    said = lambda rule, k=1: F.max(F.when(F.col("line").rlike(rule), F.regexp_extract("line", rule, k)))
    whole = lambda rule, k=1: said(rule, k).cast("long")
    vlan, l3, l4 = "^  VLAN id=(\\d+) pri=(\\d+)$", "^L3: IPv(\\d) (\\S+)->(\\S+) ", "^L4: (TCP|UDP) (\\d+)->(\\d+)"
    ok = lambda which: F.max(F.when(F.col("line") == f"  {which}=OK", 1).when(F.col("line") == f"  {which}=BAD", 0))
    http, shown = "^HTTP (\\S+) host=(.*) path=(.*)$", "^(?:PayloadPreview|FrameBytes)\\((\\d+)B\\): ?(.*)$"
    first = lambda rule, k: F.min(F.when(F.col("line").rlike(rule), F.regexp_extract("line", rule, k).cast("long")))
    said_there = lines.groupBy(*_OF, "record").agg(
        whole("^=== Frame (-?\\d+) ===$").alias("frame_no"),
        said("^ts_epoch=(\\S+)").cast("decimal(30,6)").alias("ts_epoch"), said(" t_rel=(\\S+)s$").cast("decimal(30,6)").alias("t_rel"),
        said("^L2: Ethernet src=(\\S+)").alias("eth_src"), said("^L2: .* dst=(\\S+)").alias("eth_dst"), said("^L2: .* type=(\\S+)").alias("eth_type"),
        first(vlan, 1).alias("vlan_id"), first(vlan, 2).alias("vlan_prio"),
        whole(l3, 1).alias("ip_version"), said(l3, 2).alias("ip_src"), said(l3, 3).alias("ip_dst"),
        whole("^L3: .* (?:proto|nh)=(\\d+)").alias("ip_proto"), whole("^L3: .* (?:ttl|hlim)=(\\d+)").alias("ttl_hlim"), whole("^L3: .* id=(\\d+)").alias("ip_id"),
        whole("^L3: .* DSCP=(\\d+)").alias("dscp"), whole("^L3: .* ECN=(\\d+)").alias("ecn"), whole("^L3: .* frag_off=(\\d+)").alias("ip_frag_off"),
        ok("IPv4_checksum").alias("ipv4_checksum_ok"), ok("L4_checksum").alias("l4_checksum_ok"),
        said(l4, 1).alias("_l4"), whole(l4, 2).alias("sport"), whole(l4, 3).alias("dport"), said("^L4: TCP .* flags=(\\S*)").alias("tcp_flags"), whole("^L4: TCP .* win=(\\d+)").alias("tcp_win"),
        said("^TLS SNI=(.*)$").alias("tls_sni"), said(http, 1).alias("http_method"), F.nullif(said(http, 2), F.lit("None")).alias("http_host"), F.nullif(said(http, 3), F.lit("None")).alias("http_path"),
        whole(shown, 1).alias("shown_bytes"), F.unhex(F.replace(said(shown, 2), F.lit(" "), F.lit(""))).alias("shown"),
    )
    met = [(F.min if c.startswith("vlan_") else F.max)(c).alias(c) for c in said_there.columns if c not in (*_OF, "record")]  # as above
    out = said_there.repartition(parts, "file", "record").groupBy("file", "record").agg(*met)
    return out.withColumn("l4_proto", F.when(F.col("_l4") == "TCP", 6).when(F.col("_l4") == "UDP", 17)).drop("file", "record", "_l4")


def read_flow_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of flows of a log."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.make_valid_utf8("value").alias("line"))
    return lines.where(F.col("line").rlike("^\\S+:\\d+ -> \\S+:\\d+ proto=\\d+ pkts="))
