"""Bidirectional flow keys: the lower (ip, port) end first, by string order of the ip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["flow_src_ip", "flow_dst_ip", "flow_proto", "flow_src_port", "flow_dst_port"]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds the key and `fwd`; all NULL for packets other than TCP or UDP over IP."""
    src, dst = F.struct(F.col("ip_src"), F.col("sport")), F.struct(F.col("ip_dst"), F.col("dport"))
    fwd = F.when(F.col("ip_src").isNotNull() & F.col("l4_proto").isin(6, 17), src <= dst)
    ends = lambda a, b: F.when(F.col("fwd"), a).when(~F.col("fwd"), b)
    return packets.withColumn("fwd", fwd).withColumns(
        {
            "flow_src_ip": ends(F.col("ip_src"), F.col("ip_dst")),
            "flow_dst_ip": ends(F.col("ip_dst"), F.col("ip_src")),
            "flow_proto": F.when(F.col("fwd").isNotNull(), F.col("l4_proto")),
            "flow_src_port": ends(F.col("sport"), F.col("dport")),
            "flow_dst_port": ends(F.col("dport"), F.col("sport")),
        }
    )
