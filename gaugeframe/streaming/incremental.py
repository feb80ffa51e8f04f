"""Profiles that follow a stream: value counts are additive, so each micro-batch adds its own and nothing is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeframe.operators import statistics
from gaugeframe.operators.columns import KEY, raw_counts, standardised


class ProfileState:
    """Counts of raw values by micro-batch in a folder; a batch that is replayed overwrites itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, batch: DataFrame, epoch: int) -> None:
        raw_counts(batch).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def counts(self) -> DataFrame:
        raw = self.spark.read.parquet(self.path).groupBy(*KEY, "value").agg(F.sum("cnt").alias("cnt"))
        return standardised(raw).groupBy(*KEY, F.col("new").alias("value")).agg(F.sum("cnt").alias("cnt"))

    def basics(self) -> DataFrame:
        """Counts, ratios and types of all columns so far."""
        vc = self.counts()
        return statistics.basics(vc).join(statistics.inferred(vc), list(KEY))


def followed(stream: DataFrame, state: ProfileState, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds what is there to the state and then ends."""
    return stream.writeStream.foreachBatch(state.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
