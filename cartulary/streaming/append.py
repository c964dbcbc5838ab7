"""Incremental layers: a stream of feature files that keeps the feature table and a cell index up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators.index import SpatialIndex
from cartulary.schema import FEATURE_SCHEMA


def read_features(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(FEATURE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_index(features: DataFrame, index: SpatialIndex, features_path: str, index_path: str, checkpoint: str):
    """Start a query that writes each batch's features and index rows.

    A batch is written below its own number, and a repeated batch replaces what
    it wrote, so every feature counts once however often a batch is retried.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{features_path}/batch={number}")
        index.index(batch).sortWithinPartitions(index.sort_key).write.mode("overwrite").parquet(f"{index_path}/batch={number}")
        batch.unpersist()

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows per key and tumbling window, for streams whose rows may be late by so much."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
