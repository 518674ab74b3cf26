"""Run a stream over what is available and read the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import derive


#: Time, number and process of the event that ends a finite stream; no real event has them.
END_TIME, END_SEQ = "2200-01-01 00:00:00", -1
#: Longer than any table: files may come in any order and nothing is late.
WHOLE_TABLE = "36500 days"


def event_stream(spark: SparkSession, folder: str, max_files: int = 1, end: str | None = None) -> DataFrame:
    """The generic event table, one file or a folder of part files, as a stream of canonical events.

    ``end`` is a folder for the end marker of ``drain``: files that come to it join the stream.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # As a pattern the path may name a file as well as a folder.
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder}/events.parque[t]")
    if end is not None:
        spark.createDataFrame([], schema).write.mode("append").parquet(end)
        raw = raw.unionByName(spark.readStream.schema(schema).parquet(end))
    return derive(raw)


def write_end(spark: SparkSession, folder: str, end: str) -> None:
    """The end marker: an event later than all others, which moves the watermark past them."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    known = {"event_id": F.lit(END_SEQ), "user_id": F.lit(END_SEQ), "ts": F.lit(END_TIME), "event_type": F.lit("error"), "value": F.lit(0), "props": F.lit('{"k": 0}')}
    row = [known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*row).write.mode("append").parquet(end)


def drain(df: DataFrame, path: str, mode: str = "append", source: str | None = None, end: str | None = None) -> DataFrame:
    """Write everything available to Parquet under ``path`` and read it.

    With ``end`` (the folder that ``event_stream`` was given, over the tables in
    ``source``) the stream runs on to its end: the marker closes every window
    and releases whatever waits.
    """
    def run() -> None:
        (df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination())

    run()
    if end is not None:
        write_end(df.sparkSession, source, end)
        run()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")


def batches(df: DataFrame, writer, checkpoint: str):
    """foreachBatch over everything available."""
    query = df.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
