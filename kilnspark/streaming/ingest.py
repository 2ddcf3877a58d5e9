"""Streams: new files into the chunk table, event-time windows, and state per conversation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Process what is new and stop: each micro-batch is transformed and appended once.

    A batch is written to a folder of its own number, so a batch that is run again
    replaces itself instead of being written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch).write.mode("overwrite")
        (out.partitionBy(partition_by) if partition_by else out).parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts and sums per event type in event-time windows; the same plan for batch and stream."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", late) if events.isStreaming else timed
    windowed = timed.groupBy(F.window("_t", length, slide) if slide else F.window("_t", length), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "total"
    )


def latest_state(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Running state of each conversation: messages seen and the last user text."""
    return messages.groupBy(key).agg(
        F.count("*").alias("messages"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("last_user")
    )


def state_stream(messages: DataFrame, target: str, checkpoint: str, key: str = "conv_id"):
    """:func:`latest_state` of a stream of messages, kept in Spark's state store.

    After each batch ``target`` holds the state of every conversation that the batch changed
    under ``batch=<n>``; the highest batch of a conversation is its state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    changed = latest_state(messages, key).writeStream.outputMode("update")
    return changed.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
