"""Sufficient statistics of a stream of finished feature rows: products add up, so each micro-batch only adds its own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gram import gram_table


class GramStream:
    """start(df) writes each micro-batch's products to `folder`, a subfolder each; table(spark) adds them up.

    Nothing is held by the driver: a stream that restarts from its checkpoint goes on adding, and a batch that is replayed after
    a failure replaces its own products, so it counts once.
    """

    def __init__(self, columns: Sequence[str], folder: str):
        self.columns, self.folder = tuple(columns), folder.rstrip("/")

    def add(self, batch: DataFrame, epoch: int) -> None:
        gram_table(batch, self.columns).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (a, b, value) over all batches so far, '1' for the constant."""
        parts = spark.read.schema("a string, b string, value double, epoch long").parquet(self.folder)
        return parts.groupBy("a", "b").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
