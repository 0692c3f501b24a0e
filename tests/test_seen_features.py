"""The features that models see, without what they do not need."""

from flowlens.operators.features import features, seen_features
from flowlens.plans.packets import packets
from pyspark.sql import functions as F

from conftest import SMALL


def test_seen_features_are_those_of_all(spark):
    """In several segments and with packets of no flow: equal rows, by a plan without payloads and address counts."""
    table = packets(spark, SMALL).withColumn("ip_src", F.when(F.col("frame_no") % 7 != 3, F.col("ip_src")))
    seen = seen_features(table, 100, keep=("k",))
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" not in plan and "_macs" not in plan and plan.count("Join") == 1
    want = features(table, width=100, keep=("k",)).select(*seen.columns)
    assert [(n, t) for n, t in seen.dtypes] == [(n, t) for n, t in want.dtypes]
    assert sorted(map(repr, seen.collect())) == sorted(map(repr, want.collect()))
