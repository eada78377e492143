"""Streams: windowed counts with late data, and upserts of arriving batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import TableStore


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; works on streams and tables alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def upsert_stream(batches: DataFrame, store: TableStore, name: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the rows of its keys, in the files that hold them.

    A batch's number is marked in the commit, so one that comes twice changes nothing.
    """
    return batches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: store.upsert(name, df, keys, order, mark=(checkpoint, k))).start()
