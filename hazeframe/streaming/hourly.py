"""Structured Streaming forms: hourly last write with a watermark, sliding windows, last-good state, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazeframe.operators.snapshot import SnapshotStore


def on_time(events: DataFrame, time: str, late: str = "12 hours", now: Column | None = None, future: str = "15 minutes") -> DataFrame:
    """Watermark against late rows, and a filter against rows from the future if a clock is given."""
    out = events.withWatermark(time, late)
    return out if now is None else out.where(F.col(time) <= now + F.expr(f"interval {future}"))


def hourly_last(events: DataFrame, key: str, time: str, value: str, *order: str) -> DataFrame:
    """Last written value per key and tumbling hour."""
    return events.groupBy(key, F.window(time, "1 hour").alias("w")).agg(F.max_by(value, F.struct(*order)).alias(value)).select(key, F.col("w.start").alias("hour"), value)


def sliding_mean(events: DataFrame, key: str, time: str, value: str, span: str = "12 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(key, F.window(time, span, step).alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.end").alias("until"), "mean", "n")


def drained(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over all that is there and stop. A batch has a folder of its own below the sink, so one that is tried again
    replaces itself; complete results replace the one folder they have. Read the sink by its folders: `sink/*`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{f'{number:08d}' if mode == 'append' else 'whole'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def published(stream: DataFrame, store: SnapshotStore, name: str, checkpoint: str, interval: str | None = "900 seconds") -> StreamingQuery:
    """Publish each micro-batch as the snapshot that its id says; without an interval, all that is there and stop.

    A batch that is tried again after it was published changes nothing. A stream with another checkpoint that publishes
    into the same store fails with Conflict at the first number that is taken.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.foreachBatch(lambda batch, number: store.publish({name: batch}, number + 1, f"{checkpoint}:{number}") and None).start()
