"""Streaming forms: results must equal the batch operators'."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.transforms import transform_events
from ..sources.sinks import file_writer, sink, transforming
from ..streaming.asof import asof_stream
from ..streaming.joins import pair_callstack_stream, pair_set_value_stream, windowed_counts
from ..streaming.run import END_SEQ, WHOLE_TABLE, drain, event_stream
from ..streaming.sequence import sequence_stream
from .joins import SET_VALUE_SQL
from .registry import ev_sql, query, scratch
from .sequences import HOUR, SAME, SAME_VALUE_SQL, TWO, sequence_sql, seqs, source, typed


@query("q1_stream_sequence", sequence_sql(source("CAST(pid AS VARCHAR)", typed("error", "purchase")), 2, 12 * HOUR))
def q1_stream(spark, sf):
    end = scratch(spark, "end")
    found = sequence_stream(event_stream(spark, sf, end=end), TWO, watermark=WHOLE_TABLE)
    return seqs(drain(found, scratch(spark, "sequence"), source=sf, end=end))


@query("q5_stream_same_value", SAME_VALUE_SQL)
def q5_stream(spark, sf):
    """Steps that ask for an earlier event's value on a stream: pending events by value in the state store."""
    end = scratch(spark, "end")
    found = sequence_stream(event_stream(spark, sf, end=end), SAME, watermark=WHOLE_TABLE)
    return seqs(drain(found, scratch(spark, "same"), source=sf, end=end))


@query("q12_tumbling_window", ev_sql("""
SELECT date_trunc('hour', ts) AS interval_start, host AS key, count(*) AS n FROM ev GROUP BY ALL"""))
def q12(spark, sf):
    # A window is reported once the watermark has passed its end; the marker closes all but its own.
    end = scratch(spark, "end")
    counts = windowed_counts(event_stream(spark, sf, end=end), "host", "1 hour", delay=WHOLE_TABLE)
    out = drain(counts, scratch(spark, "windows"), source=sf, end=end)
    return out.select(F.col("interval_start").cast("timestamp_ntz").alias("interval_start"), "key", "n")


@query("s12_batched_publish", ev_sql("SELECT seq, CAST(k AS VARCHAR) AS level, pid FROM ev"))
def s12(spark, sf):
    path = scratch(spark, "publish")
    steps = [("rename", [("k", "level")]), ("remove", ["status"])]
    writer = transforming(file_writer(f"{path}/out"), lambda batch: transform_events(batch, steps))
    running = sink(event_stream(spark, sf), writer, checkpoint=f"{path}/checkpoint", available_now=True)
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("seq", F.col("params")["level"].alias("level"), "pid")


@query("q13_micro_batch_flush", ev_sql("SELECT category, count(*) AS n FROM ev GROUP BY category"))
def q13(spark, sf):
    path = scratch(spark, "flush")
    running = sink(event_stream(spark, sf), file_writer(f"{path}/out", partition_by=["category"]), trigger="250 milliseconds",
                   checkpoint=f"{path}/checkpoint")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{path}/out").groupBy("category").agg(F.count("*").alias("n"))


@query("q14_unpaired_release", ev_sql("SELECT seq, CASE WHEN seq % 5 < 3 THEN 'stack' || seq END AS stack FROM ev"))
def q14(spark, sf):
    late = F.expr("make_dt_interval(0, 0, 0, CAST(pmod(seq, 5) AS DECIMAL(18,6)) * 0.2)")
    end = scratch(spark, "end")
    events = event_stream(spark, sf, end=end).select("seq", "host", "ts", F.col("seq").alias("stack_id"))
    walks = event_stream(spark, sf, end=end).select("host", F.col("seq").alias("stack_id"), (F.col("ts") + late).alias("ts"),
                                                    F.concat(F.lit("stack"), F.col("seq").cast("string")).alias("callstack"))
    out = drain(pair_callstack_stream(events, walks, delay=WHOLE_TABLE), scratch(spark, "stacks"), source=sf, end=end)
    return out.where(F.col("seq") != END_SEQ).select("seq", F.col("callstack").alias("stack"))


@query("q15_state_ttl", ev_sql("""
SELECT seq, n AS name FROM (SELECT seq, n, row_number() OVER (PARTITION BY host, n, k ORDER BY ts, seq) AS r FROM (
 SELECT *, CASE event_type WHEN 'click' THEN 'ProcessRundown' ELSE name END AS n FROM ev)) WHERE r = 1"""))
def q15(spark, sf):
    from ..sources.events import dedup_rundown
    name = F.when(F.col("event_type") == "click", F.lit("ProcessRundown")).otherwise(F.col("name"))
    df = event_stream(spark, sf).withColumn("name", name).withWatermark("ts", "40 days")
    out = dedup_rundown(df.select("seq", "ts", "host", "name", "k"), key=F.col("k").cast("string"))
    return drain(out, scratch(spark, "rundown")).select("seq", "name")


@query("j1_process_stream", ev_sql("""
SELECT e.seq, CASE WHEN epoch_us(e.ts) - epoch_us(p.ts) <= 21600000000 THEN p.k END AS started_k FROM ev e
 ASOF LEFT JOIN (SELECT pid, host, max(ts) AS ts, arg_max(k, seq) AS k FROM ev WHERE name = 'CreateProcess' GROUP BY pid, host, epoch_us(ts)) p
 ON e.host = p.host AND e.pid = p.pid AND e.ts >= p.ts"""))
def j1_stream(spark, sf):
    """Process state on a stream, six hours to live."""
    end = scratch(spark, "end")
    events = event_stream(spark, sf, end=end).select("host", "pid", "seq", "ts")
    starts = event_stream(spark, sf, end=end).where("name = 'CreateProcess'").select("host", "pid", "seq", "ts", F.col("k").alias("started_k"))
    out = drain(asof_stream(events, starts, ["host", "pid"], ["started_k"], "6h", watermark=WHOLE_TABLE), scratch(spark, "process"), source=sf, end=end)
    return out.where(F.col("seq") != END_SEQ).select("seq", "started_k")


@query("j7_set_value_stream", ev_sql(SET_VALUE_SQL))
def j7_stream(spark, sf):
    """Internal writes pair one to one with value writes of the same process on a stream, eight hours to live."""
    end = scratch(spark, "end")
    df = event_stream(spark, sf, end=end)
    parity = F.pmod("seq", F.lit(2)).alias("value_name")
    # The marker that ends the stream stands among the writes, so that it moves the watermark.
    left = df.where(F.col("event_type").isin("purchase") | (F.col("seq") == END_SEQ)).select("seq", "host", "pid", "ts", parity)
    right = event_stream(spark, sf, end=end).where((F.col("event_type") == "signup") | (F.col("seq") == END_SEQ)).select(
        "seq", "host", "pid", "ts", parity, F.lit("REG_SZ").alias("value_type"), F.col("seq").cast("string").alias("data"))
    out = drain(pair_set_value_stream(left, right, ttl="8h", delay=WHOLE_TABLE), scratch(spark, "values"), source=sf, end=end)
    return out.where(F.col("seq") != END_SEQ).select("seq", F.col("data").cast("long").alias("right_seq"))
