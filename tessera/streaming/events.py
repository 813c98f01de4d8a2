"""Micro-batches and event-time windows (section 2.13).

The engine's own behaviour is scheduled micro-batches over a backlog; windows
and watermarks over an event stream are extensions. Window functions take a
batch or a streaming DataFrame alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with a timestamp in UTC, a watermark, and each id once within it."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return at.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else at.dropDuplicates(["event_id"])


def tumbling(events: DataFrame, length: str = "1 hour") -> DataFrame:
    return _counts(events, F.window("ts", length))


def sliding(events: DataFrame, length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    return _counts(events, F.window("ts", length, step))


def _counts(events: DataFrame, window) -> DataFrame:
    out = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> None:
    """Process all that has arrived, batch by batch, then stop.

    The checkpoint remembers what is done, so a second run takes only what is
    new; ``step`` gets the batch and its number and must be idempotent in it.
    """
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def pending(backlog: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What has no checkpoint row yet."""
    return backlog.join(done.select(*keys), list(keys), "left_anti")


def settled(polls: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Keys with two consecutive clean ``processed`` polls."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    twice = (F.col(status) == "processed") & (F.lag(status).over(w) == "processed")
    return polls.withColumn("_t", twice).groupBy(key).agg(F.coalesce(F.bool_or("_t"), F.lit(False)).alias("settled"))
