"""Packet scores: reputation of the source, else of the destination, else heuristics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.functions.header import flag_letters, public_ip
from flowlens.functions.text import plain, risk_level
from flowlens.operators.rules import coerced, with_heuristics
from flowlens.schema import SCORE_COLS


def parsed_reputation(reputation: DataFrame) -> DataFrame:
    """ip, rep_score, rep_risk, rep_reason of (ip, payload): a missing score is 0, one that is no number NULL."""
    scam = "$.scamalytics"
    raw = F.get_json_object("payload", f"{scam}.scamalytics_score")
    risk = F.get_json_object("payload", f"{scam}.scamalytics_risk")
    has = F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object("payload", scam)), "scamalytics_score"), F.lit(False))
    score = F.when(~has, F.lit(0)).otherwise(raw.try_cast("double").cast("int"))
    level = F.when(risk.isNotNull(), plain(risk))
    return reputation.select(F.trim("ip").alias("ip"), score.alias("rep_score"), level.alias("rep_risk"), F.coalesce(level, F.lit("scamalytics_unknown")).alias("rep_reason"))


def with_reputation(features: DataFrame, reputation: DataFrame) -> DataFrame:
    """Adds rep_score, rep_level and rep_reason: source first, then destination; public addresses only.

    The reason is the risk where an address is looked up for the first time, and
    public_ip after that, in order of frames, source before destination.
    """
    known = parsed_reputation(reputation)
    joined = features
    for side in ("src", "dst"):
        named = known.select(*[F.col(c).alias(f"{side}_{c}") for c in known.columns])
        ip = F.when(public_ip(F.col(f"ip_{side}")), F.trim(f"ip_{side}"))
        joined = joined.withColumn(f"_{side}", ip).join(named, F.col(f"_{side}") == F.col(f"{side}_ip"), "left")
    hit = lambda s: F.col(f"{s}_rep_score").isNotNull()
    # First lookups by address: a minimum over events, not a window over all of them.
    looked = joined.select("frame_no", F.posexplode(F.array(F.col("src_ip"), F.when(~hit("src"), F.col("dst_ip")))).alias("side", "ip")).where("ip is not null")
    first = looked.groupBy("ip").agg(F.min(F.struct("frame_no", "side")).alias("first"))
    side = F.when(hit("src"), 0).when(hit("dst"), 1)
    joined = joined.withColumn("_used", F.when(side == 0, F.col("src_ip")).when(side == 1, F.col("dst_ip")))
    joined = joined.join(first.withColumnRenamed("ip", "_first_ip"), F.col("_used") == F.col("_first_ip"), "left")
    fresh = (F.col("first.frame_no") == F.col("frame_no")) & (F.col("first.side") == side)
    pick = lambda c: F.when(side == 0, F.col(f"src_{c}")).when(side == 1, F.col(f"dst_{c}"))
    score = pick("rep_score")
    level = F.coalesce(F.nullif(pick("rep_risk"), F.lit("")), risk_level(score))
    return joined.select(
        *features.columns,
        score.alias("rep_score"),
        F.when(score.isNotNull(), level).alias("rep_level"),
        F.when(score.isNotNull(), F.when(fresh, pick("rep_reason")).otherwise("public_ip")).alias("rep_reason"),
    )


def scores(features: DataFrame, reputation: DataFrame | None = None, label=None) -> DataFrame:
    """Features, flag bits, label, and the four score columns at the end.

    Without reputation, or with none for an address, heuristics score.
    """
    df = with_heuristics(coerced(features)).withColumns(flag_letters(F.col("tcp_flags")))
    df = df.withColumn("label", F.lit(None).cast("string") if label is None else label)
    if reputation is None:
        df = df.withColumns({"rep_score": F.lit(None).cast("int"), "rep_level": F.lit(None).cast("string"), "rep_reason": F.lit(None).cast("string")})
    else:
        df = with_reputation(df, reputation)
    score = F.coalesce("rep_score", "heuristic_score")
    df = df.withColumns(
        {
            "ip_fraud_score": score,
            "ip_fraud_score_display": F.concat(score.cast("string"), F.lit("/100")),
            "risk_level": F.coalesce("rep_level", risk_level(F.col("heuristic_score"))),
            "risk_score_reason": F.coalesce("rep_reason", "heuristic_reason"),
        }
    )
    return df.select(*features.columns, *flag_letters(F.col("tcp_flags")), "label", *SCORE_COLS)
