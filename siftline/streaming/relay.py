"""Streams: an outbox relay and reconciliation of scans that arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.findings import reconcile


def relay(events: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Sends each batch of new events, oldest first, to ``publish`` (batch, id), which must be idempotent by batch id."""
    return events.writeStream.foreachBatch(lambda batch, no: publish(batch.orderBy("created_at", "event_id"), no)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and key with a watermark; the same plan on a stream and on a table."""
    x = events.withWatermark(time, late) if events.isStreaming else events
    return x.groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def reconcile_stream(findings: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Reconciles every batch of findings with the one before, kept as Parquet below ``state`` by batch id."""

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        now = batch.select("ord", "issue_id", "content_signature")
        now.write.mode("overwrite").parquet(f"{state}/findings/{no}")
        before = spark.read.parquet(f"{state}/findings/{no - 1}") if no else None
        reconcile(spark.read.parquet(f"{state}/findings/{no}"), before).write.mode("overwrite").parquet(f"{state}/status/{no}")

    return findings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
