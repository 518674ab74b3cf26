"""Capture to and replay from partitioned Parquet tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.enrich import enrich_file_path, enrich_process
from .events import drop_state_events, event_struct

def event_size(df: DataFrame) -> Column:
    return F.octet_length(F.to_json(event_struct(df)))


def write_capture(df: DataFrame, snapshot: DataFrame | None, path: str, checkpoint: str | None = None):
    """Write every event by date and category, plus the initial handle snapshot.

    Returns the statistics of the written events (batch) or the running query
    (stream). Sizes are those of the events' JSON.
    """
    dated = df.withColumn("date", F.to_date("ts"))
    if snapshot is not None:
        snapshot.write.mode("overwrite").parquet(f"{path}/handles")
    if df.isStreaming:
        return (dated.writeStream.format("parquet").partitionBy("date", "category").option("path", f"{path}/events")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    seen = Observation("capture")
    observed = dated.observe(
        seen, F.count(F.lit(1)).alias("events"), F.sum(event_size(df)).alias("bytes"),
        F.count_if(F.col("name") == "CreateProcess").alias("processes"), F.count_if(F.col("name") == "CreateHandle").alias("handles"))
    # Rebalancing merges small and splits large (date, category) groups before the write.
    observed.hint("rebalance", "date", "category").write.mode("overwrite").partitionBy("date", "category").parquet(f"{path}/events")
    return seen.get


def replay_capture(spark: SparkSession, path: str, where: Callable[[DataFrame], Column] | None = None, stream: bool = False,
                   enrich: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 64) -> DataFrame:
    """Captured events with state rebuilt by ``enrich``, state-only events dropped, then filtered.

    A filter on date or category prunes partitions. Order comes from (ts, seq)
    in whatever consumes the events, not from the files.
    """
    batch = spark.read.parquet(f"{path}/events")
    df = batch
    if stream:
        df = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", max_files).parquet(f"{path}/events")
    if enrich is not None:
        df = enrich(df)
    df = drop_state_events(df)
    return df if where is None else df.where(where(df))


def rebuild_state(events: DataFrame, handles: DataFrame | None = None) -> DataFrame:
    """Captured events with ``ps`` and, in ``params``, the ``file_path`` that their file object had at event time.

    Process starts and rundowns give the processes. Creations and rundowns of
    files open a file object, closing events free it; ``handles`` (host,
    file_object, path), the snapshot of the capture, was there before the first
    event. A path that an event brings itself stays, and a rundown or creation
    counts from its own time on. For a finished capture, as order comes from the
    events' times.
    """
    p, object_of = F.col("params"), F.expr("try_cast(params['file_object'] as bigint)")
    named = events.withColumns({"file_object": object_of, "file_key": F.expr("try_cast(params['file_key'] as bigint)")})
    opens = named.where(F.col("name").isin("CreateFile", "FileRundown") & p["file_path"].isNotNull() & F.col("file_object").isNotNull())
    opened = opens.select("host", "file_object", "ts", p["file_path"].alias("path"), p["file_type"].alias("type"))
    closed = named.where(F.col("name") == "CloseFile").select("host", "file_object", "ts")
    known = None
    if handles is not None:
        known = handles.select("host", F.col("file_object").cast("bigint").alias("file_object"), F.timestamp_seconds(F.lit(0)).alias("ts"), "path")
    about = named.drop(*({"file_path", "file_type"} & set(named.columns)))
    found = enrich_file_path(about, opened, closed, known)
    add = F.col("file_path").isNotNull() & p["file_path"].isNull()
    whole = F.when(add, F.map_concat(p, F.create_map(F.lit("file_path"), F.col("file_path")))).otherwise(p)
    return enrich_process(found.withColumn("params", whole).select(*events.columns))


def replay_with_state(spark: SparkSession, path: str, where: Callable[[DataFrame], Column] | None = None, snapshot: bool = True) -> DataFrame:
    """A finished capture replayed with its state: rundowns and the handle snapshot are read before anything is filtered."""
    return replay_capture(spark, path, where, enrich=lambda df: rebuild_state(df, replay_handles(spark, path) if snapshot else None))


def replay_handles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/handles")
