"""Windowed and deduplicating stream operators built on watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key
from ..sources.sinks import batch_store


def idle_sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Activity of a page up to a quiet gap; a session appears once the watermark passes its end.

    A closing sentinel is a session of its own, which the watermark never passes.
    """
    session = F.session_window("ts", gap)
    grouped = events.withWatermark("ts", delay).groupBy("page_id", session.alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select("page_id", F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), "n_events")


def error_rates(errors: DataFrame, length: str, slide: str | None, delay: str) -> DataFrame:
    """Errors per tally in tumbling (no ``slide``) or sliding windows."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = errors.withWatermark("ts", delay).groupBy(span.alias("w"), "tally").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "tally", "n")


def first_writes(objects: DataFrame, delay: str) -> DataFrame:
    """First object of each content key; the watermark only bounds the state kept for it."""
    keyed = objects.withColumn("key", content_key(F.col("content")))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key"])


def content_writer(path: str, app: str = "content"):
    """``foreachBatch`` function storing each content key once; ``app`` names the delivering stream."""
    store = batch_store(path, app, "key STRING", "key", F.sha1)
    return lambda batch, batch_id: store(batch.select("key").distinct(), batch_id)
