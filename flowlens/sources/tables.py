"""CSV and Parquet tables with fixed schemas, and training files with their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from flowlens.schema import FEATURE_COLS, FLOW_COLS, SSH_SMB
from flowlens.sources.shared import written

_TEXT = set("""ts_local eth_src eth_dst eth_type ip_src ip_dst tcp_flags flow_protocol_hint flow_risk_level flow_risk_reason flow_src_ip flow_dst_ip
flow_http_method flow_http_host flow_http_path flow_http_detect_source flow_tls_sni flow_tls_detect_source flow_ssh_banner flow_ssh_detect_source flow_smb_version flow_smb_detect_source""".split())
_REAL = {"ts_epoch", "t_rel", "flow_duration", "flow_iat_min", "flow_iat_avg", "flow_iat_max"}
_LONG = {"frame_no", "len_bytes"}


def schema_of(columns: list[str]) -> StructType:
    kind = lambda c: StringType() if c in _TEXT else DoubleType() if c in _REAL else LongType() if c in _LONG or c.endswith(("pkts", "bytes", "_count")) else IntegerType()
    return StructType([StructField(c, kind(c)) for c in columns])


FEATURES, FLOWS = schema_of(FEATURE_COLS), schema_of(FLOW_COLS)
WIDE_FEATURES = schema_of([*FEATURE_COLS, *SSH_SMB])


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is text.  Empty fields are NULL."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, old files replaced."""
    df.write.mode("overwrite").option("header", True).csv(path)


#: Rows of a chunk of a training file; most blocks sent to every task.
CHUNK_ROWS, BLOCKS = 200_000, 100_000


def joined_to_blocks(df: DataFrame, blocks: DataFrame, *parts: str) -> DataFrame:
    """df with the row of its block, or of the part of a block that columns `parts` name, which must be there; blocks is a written table."""
    found = blocks.withColumn("_found", F.lit(True))
    out = df.join(F.broadcast(found) if blocks.limit(BLOCKS + 1).count() <= BLOCKS else found, ["file", "block", "_task", *parts], "left")
    changed = F.raise_error(F.lit("files were split otherwise when read again"))
    return out.withColumn("_found", F.when(F.col("_found"), True).otherwise(changed.cast("boolean")))


def with_blocks(df: DataFrame) -> DataFrame:
    """df, as read from line-wise files, with file, block (where a task's split of it begins), _task and _id, which rises by 1 within a block."""
    own = F.monotonically_increasing_id()
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.shiftright(own, 33).alias("_task"), own.alias("_id"))


def numbered_rows(df: DataFrame) -> DataFrame:
    """df, as read from line-wise files, with file and row, from 0 within its file, whatever the splits.

    Rows are counted by block, the counts summed up over a file's blocks, a row each, and each row adds its place in its block.
    """
    df = with_blocks(df)
    counts = df.groupBy("file", "block", "_task").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = written(counts.select("file", "block", "_task", (before - F.col("first")).alias("_shift")), "blocks")
    return joined_to_blocks(df, blocks).where("_found").withColumn("row", F.col("_id") + F.col("_shift")).drop("_task", "_id", "_shift", "_found", "block")


def read_training(spark: SparkSession, pattern: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of all CSV files of a glob with `file`, `row` (from 0 within its file) and `chunk`, of chunk_rows rows each."""
    return numbered_rows(read_csv(spark, pattern)).withColumn("chunk", F.floor(F.col("row") / chunk_rows))
