"""One entry to packets, features, flows, scores, dashboard queries and training."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from flowlens.functions.capture_filter import default_filter
from flowlens.ml import models, prep
from flowlens.operators import dashboard, flows, scores
from flowlens.operators.features import features
from flowlens.sources.pcap import decoded, numbered, read_pcap


class Engine:
    """Lazy tables over one packet table; nothing runs before a result is asked for."""

    dashboard = dashboard

    def __init__(self, packets: DataFrame):
        self.packets = packets

    @classmethod
    def from_capture(cls, spark: SparkSession, path: str, filtered: bool = True) -> Engine:
        packets = decoded(numbered(read_pcap(spark, path)))
        return cls(packets.where(default_filter()) if filtered else packets)

    def features(self, wide: bool = False) -> DataFrame:
        return features(self.packets, wide)

    def flows(self) -> DataFrame:
        return flows.flows(self.packets)

    def scores(self, model: PipelineModel | None = None, reputation: DataFrame | None = None) -> DataFrame:
        table = self.features()
        if model is None:
            return scores.scores(table, reputation)
        labelled = models.score(model, table).select("frame_no", "label")
        return scores.scores(table, reputation).drop("label").join(labelled, "frame_no")

    @staticmethod
    def train(kind: str, labelled: DataFrame, **options) -> PipelineModel:
        return models.fit(kind, prep.prepared(labelled), **options)
