"""Sinks: batched publishing of events and alerts to Spark data sources."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Writer = Callable[[DataFrame, int], None]


def file_writer(path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> Writer:
    """Appends each batch under its own folder, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.write.mode("overwrite").format(fmt)
        if partition_by:
            out = out.partitionBy(*partition_by)
        out.save(f"{path}/batch={batch_id}")
    return write


def source_writer(fmt: str, **options) -> Writer:
    """Any installed Spark data source that takes batch writes (jdbc, kafka, …)."""
    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.format(fmt).options(**options).mode("append").save()
    return write


def transforming(writer: Writer, transform: Callable[[DataFrame], DataFrame]) -> Writer:
    return lambda batch, batch_id: writer(transform(batch), batch_id)


def sink(df: DataFrame, writer: Writer | str, trigger: str | None = "250 milliseconds", checkpoint: str | None = None,
         available_now: bool = False, output_mode: str = "append"):
    """Publish a batch or a stream. ``"noop"`` discards, ``"console"`` prints, a function gets each micro-batch."""
    if not df.isStreaming:
        if isinstance(writer, str):
            return df.write.format(writer).mode("overwrite" if writer == "noop" else "append").save()
        return writer(df, 0)
    out = df.writeStream.outputMode(output_mode)
    out = out.format(writer) if isinstance(writer, str) else out.foreachBatch(writer)
    if checkpoint:
        out = out.option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime=trigger)
    return out.start()


def sink_counted(df: DataFrame, writer: Writer | str) -> int:
    """Publish a batch and return how many rows the sink itself was given."""
    seen = Observation("sink")
    sink(df.observe(seen, F.count(F.lit(1)).alias("n")), writer)
    return seen.get["n"]
