"""Streams over append-only logs: an extension, as the engine's sources are otherwise bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of JSON lines as files appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def latest(log: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key, kept up to date; the state is one row for each key."""
    return log.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), F.count(F.lit(1)).alias("n"))


def windowed(log: DataFrame, time: str, key: str, value: str, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Means by window and key; rows later than the watermark are left out and closed windows leave the state."""
    return log.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "mean", "n")


def append_once(target: str):
    """A batch sink for foreachBatch that writes each batch to a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return write
