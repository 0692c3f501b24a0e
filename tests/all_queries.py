"""Runs every query with SQL against DuckDB: python tests/all_queries.py [NAME...]"""

import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import __spark_entry__
from oracle import expected, rows
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")
for name, sql in __spark_entry__.oracle_sql().items():
    if not sys.argv[1:] or name in sys.argv[1:]:
        df = __spark_entry__.queries()[name](spark, sf_dir)
        print("same" if rows(df.collect()) == expected(sql, sf_dir, df.columns) else "DIFFERENT", name, flush=True)
