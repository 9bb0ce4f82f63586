"""Sink of update-mode streams: the last row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickforge.sources.folders import Snapshots


class LatestRows(Snapshots):
    """Sink of an update-mode stream: the last row per key, merged batch by batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        super().__init__(spark, path)
        self.keys = keys

    def write(self, rows: DataFrame, batch: int) -> None:
        known = self.before(batch)
        merged = rows.withColumn("_batch", F.lit(batch))
        if known is not None:
            merged = merged.unionByName(self.spark.read.parquet(self.folder(known)))
        last = F.max_by(F.struct(*merged.columns), "_batch").alias("row")
        newest = merged.groupBy(*[F.col(key).alias(f"_{key}") for key in self.keys]).agg(last).select("row.*")
        newest.write.mode("overwrite").parquet(self.folder(batch))
        self.finish(batch)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder(self.current())).drop("_batch")
