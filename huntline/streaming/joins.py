"""Pairings and windows on streams, bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairing import pair_stream


def pair_callstack_stream(events: DataFrame, walks: DataFrame, within: str = "500ms", delay: str = "1 second") -> DataFrame:
    """Events with the stack of their host's walk of the same mark, in either arrival order; without a stack once the bound is over.

    One walk per event and one event per walk: each takes the oldest that waits
    on the other side, as in batch.
    """
    return pair_stream(events, walks, ["host", "stack_id"], ["callstack"], within, newest=False, watermark=delay)


def pair_set_value_stream(events: DataFrame, internal: DataFrame, ttl: str = "2m", delay: str = "10 seconds") -> DataFrame:
    """Value writes with the newest internal write of the same host and process before them, if fresh, of the same name and not used yet."""
    return pair_stream(events, internal, ["host", "pid"], ["value_type", "data"], ttl, newest=True, same="value_name", watermark=delay)


def windowed_counts(events: DataFrame, key: str, every: str, delay: str = "1 minute") -> DataFrame:
    """Events per key and tumbling window, emitted when the watermark closes the window."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), F.col(key).alias("key"))
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("interval_start"), "key", "n"))
