"""Event-time windows, sessions and deduplication; the same functions serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, time: str, width: str, key: str, value: str) -> DataFrame:
    """start, key, n, total of fixed windows."""
    w = events.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return w.select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """key, start, n of sessions that a gap of `gap` or more ends."""
    w = events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), "n")


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def late_tolerant(events: DataFrame, time: str, delay: str) -> DataFrame:
    return events.withWatermark(time, delay)


def deduplicated(events: DataFrame, time: str, delay: str, key: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, once, into Parquet; the checkpoint makes it resumable."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
