"""Streams: sessions by inactivity, windowed counts and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftline.sources.keyed import KeyedTable


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(key, session_start, session_end, events) by inactivity; ``late`` is a stream's watermark."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    got = rows.groupBy(F.session_window("_ts", gap), key).agg(F.count(F.lit(1)).alias("events"))
    return got.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "events")


def windowed_counts(events: DataFrame, kind: str = "event_type", ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(window_start, kind, events, total) by tumbling, or with ``slide`` sliding, windows."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    window = F.window("_ts", width, slide) if slide else F.window("_ts", width)
    return rows.groupBy(window, kind).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), kind, "events", "total")


def upsert_stream(changes: DataFrame, into: KeyedTable, checkpoint: str, order: str = "seq") -> DataStreamWriter:
    """A writer that puts each batch of changes into a table as deltas of the buckets of its keys.

    The table notes the batch's number with its version, so a batch that runs again
    changes nothing; buckets with many deltas are written anew after a batch.
    """

    def apply(batch: DataFrame, n: int) -> None:
        into.upsert(batch, order, batch=n)
        into.compact()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True)
