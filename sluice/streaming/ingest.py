"""Streams of pages or events into stored tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queue
from ..operators.upsert import Store, upsert


def apply_stream(spark: SparkSession, source: str, schema, store: Store, change, checkpoint: str, fmt: str = "parquet") -> None:
    """Read what is new in a folder, batch by batch, and store ``change(table, batch)`` for each; ends when all has been read.

    A batch that is run again after a failure leaves the same rows: the store knows the last batch of the stream, which its checkpoint names.
    """
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).format(fmt).load(source)
    run = stream.writeStream.foreachBatch(lambda batch, n: store.change_once(lambda table: change(table, batch), name, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def ingest(spark: SparkSession, source: str, schema, store: Store, keys: list[str], policy: str, order: str, checkpoint: str, transform=lambda df: df, fmt: str = "parquet", **options) -> None:
    """Merge what is new in a folder into the store."""
    apply_stream(spark, source, schema, store, lambda table, batch: upsert(table, transform(batch), keys, policy, order, **options), checkpoint, fmt)


def keep_queue(spark: SparkSession, source: str, store: Store, checkpoint: str) -> None:
    """Apply a stream of queue events (``queue.EVENTS``) to the stored queue."""
    apply_stream(spark, source, queue.EVENTS, store, queue.apply, checkpoint)


def windowed_counts(events: DataFrame, time: str, group: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, group, n: for streams with a watermark, for tables at once."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), group, "n")
