"""Sources, sinks and renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.params import params_text
from ..functions.template import target_name
from ..operators.reports import capture_stats
from ..sources import capture, events, sinks
from ..sources.tables import telemetry, wide_telemetry
from .registry import ev_sql, json_params, params_sql, query, scratch

NTZ = "timestamp_ntz"


@query("s1_event_scan", ev_sql("SELECT seq, name, category FROM ev WHERE name IN ('CreateFile', 'Connect') AND category IN ('file', 'net')"))
def s1(spark, sf):
    return events.select_events(telemetry(spark, sf), ["CreateFile", "Connect"], ["file", "net"]).select("seq", "name", "category")


@query("s2_exclude_images", ev_sql("SELECT seq, image FROM ev WHERE image NOT IN ('error_1.exe', 'click_2.exe', 'view_0.exe')"))
def s2(spark, sf):
    df = telemetry(spark, sf).withColumn("image", F.regexp_extract("path", r"([^\\]*)$", 1))
    return events.exclude_images(df, ["error_1.exe", "click_2.exe", "view_0.exe"], process="image").select("seq", "image")


_STATE = """r AS (SELECT *, CASE event_type WHEN 'view' THEN 'FileRundown' WHEN 'click' THEN 'ProcessRundown' ELSE name END AS n FROM ev)"""


def _state_events(spark, sf):
    name = (F.when(F.col("event_type") == "view", F.lit("FileRundown"))
            .when(F.col("event_type") == "click", F.lit("ProcessRundown")).otherwise(F.col("name")))
    return telemetry(spark, sf).withColumn("name", name)


@query("s3_drop_state_events", ev_sql("SELECT seq, n AS name FROM r WHERE n NOT IN ('FileRundown', 'ProcessRundown')", _STATE))
def s3(spark, sf):
    return events.drop_state_events(_state_events(spark, sf)).select("seq", "name")


@query("s3_dedup_rundown", ev_sql("""
SELECT seq, n AS name FROM r WHERE n NOT IN ('FileRundown', 'ProcessRundown')
UNION ALL SELECT min(seq), n FROM r WHERE n = 'FileRundown' GROUP BY host, n, seq % 97
UNION ALL SELECT min(seq), n FROM r WHERE n = 'ProcessRundown' GROUP BY host, n, pid""", _STATE))
def s3b(spark, sf):
    return events.dedup_rundown(_state_events(spark, sf)).select("seq", "name")


@query("s4_source_filter", ev_sql("SELECT seq, pid, k FROM ev WHERE category = 'net' AND k >= 40 AND dport <> 53"))
def s4(spark, sf):
    from ..functions import predicates as P
    from ..functions.fields import field
    df = telemetry(spark, sf)
    keep = P.and_(P.eq(field(df, "evt.category"), "net"), P.ge(F.col("k"), 40), P.ne(field(df, "net.dport"), 53))
    return df.where(keep).select("seq", "pid", "k")


_JSON = rf"""'{{"seq":' || seq || ',"pid":' || pid || ',"tid":' || tid || ',"cpu":' || cpu || ',"name":"' || name || '","category":"' || category
 || '","description":"' || event_type || ' event","host":"' || host || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')
 || '","params":' || {json_params('ps')} || ',"meta":{{"src":"' || event_type || '"}}}}'"""


@query("s5_capture_write", params_sql(f"""
SELECT category, count(*) AS n, CAST(sum(length({_JSON})) AS BIGINT) AS bytes FROM evp GROUP BY category"""))
def s5(spark, sf):
    path = scratch(spark, "capture")
    df = telemetry(spark, sf)
    capture.write_capture(df, None, path)
    back = spark.read.parquet(f"{path}/events")
    return back.groupBy("category").agg(F.count("*").alias("n"), F.sum(capture.event_size(back)).alias("bytes"))


@query("s5_capture_statistics", params_sql(f"""
SELECT count(*) AS events, CAST(sum(length({_JSON})) AS BIGINT) AS bytes, count(*) FILTER (name = 'CreateProcess') AS processes,
 CAST(0 AS BIGINT) AS handles FROM evp"""))
def s5b(spark, sf):
    df = telemetry(spark, sf)
    return capture_stats(df, capture.event_size(df))


@query("s6_capture_replay", ev_sql("SELECT seq, r.name, pid FROM r WHERE r.name NOT IN ('FileRundown') AND category = 'file'",
                                   "r AS (SELECT seq, pid, category, CASE event_type WHEN 'view' THEN 'FileRundown' ELSE name END AS name FROM ev)"))
def s6(spark, sf):
    path = scratch(spark, "replay")
    name = F.when(F.col("event_type") == "view", F.lit("FileRundown")).otherwise(F.col("name"))
    capture.write_capture(telemetry(spark, sf).withColumn("name", name), None, path)
    return capture.replay_capture(spark, path, where=lambda d: F.col("category") == "file").select("seq", "name", "pid")


_REPLAYED = """o AS (SELECT host, seq % 97 AS obj, ts, max(path) AS path FROM ev WHERE event_type = 'click' GROUP BY ALL)"""


@query("s6_replay_with_state", ev_sql("""
SELECT e.seq, p.image AS ps_name, CASE WHEN e.event_type = 'click' THEN e.path ELSE coalesce(o.path, 'handle' || (e.seq % 97)) END AS file_path FROM (SELECT *, seq % 97 AS obj FROM ev WHERE category = 'file') e
 ASOF LEFT JOIN (SELECT * FROM ev WHERE name = 'CreateProcess') p ON e.host = p.host AND e.pid = p.pid AND e.ts >= p.ts
 ASOF LEFT JOIN o ON e.host = o.host AND e.obj = o.obj AND e.ts >= o.ts""", _REPLAYED))
def s6b(spark, sf):
    """Reads in the capture carry no path: it comes back from earlier creations and the handle snapshot, processes from their starts."""
    path = scratch(spark, "state")
    df = telemetry(spark, sf)
    bare = F.when(F.col("event_type") == "view", F.map_filter("params", lambda k, v: k != "file_path")).otherwise(F.col("params"))
    handles = df.select("host", (F.col("seq") % 97).alias("file_object")).distinct().withColumn("path", F.concat(F.lit("handle"), F.col("file_object").cast("string")))
    capture.write_capture(df.withColumn("params", bare), handles, path)
    replayed = capture.replay_with_state(spark, path, where=lambda d: F.col("category") == "file")
    return replayed.select("seq", F.col("ps.name").alias("ps_name"), F.col("params")["file_path"].alias("file_path"))


@query("s7_event_json", params_sql(f"SELECT seq, {_JSON} AS json FROM evp"))
def s7(spark, sf):
    return events.to_event_json(telemetry(spark, sf)).select("seq", "json")


@query("s8_batch_json", params_sql(f"""
SELECT seq // 250 AS batch_id, '[' || string_agg({_JSON} || chr(10), ',' ORDER BY seq) || ']' AS json FROM evp GROUP BY seq // 250"""))
def s8(spark, sf):
    return events.to_batch_json(telemetry(spark, sf), F.floor(F.col("seq") / 250))


@query("s9_pretty_lines", ev_sql("""
SELECT seq, seq || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' - ' || cpu || ' ' || pid || ' - ' || name || ' (' || status || ') ' || host AS line FROM ev"""))
def s9(spark, sf):
    template = "{{ .Seq }} {{ .Timestamp }} - {{.CPU}} {{ .Pid }} - {{ .Type }} ({{ .Params.Status }}) {{ .Host }}"
    return events.format_events(telemetry(spark, sf), template).select("seq", "line")


@query("s10_params_text", params_sql("""
SELECT seq, array_to_string(list_transform(ps, lambda e: e.k || '=' || e.v), ', ') AS snake,
 array_to_string(list_transform(ps, lambda e: array_to_string(list_transform(string_split(e.k, '_'), lambda w: upper(w[1]) || w[2:]), '') || ': ' || e.v), ', ') AS pascal FROM evp"""))
def s10(spark, sf):
    p = F.col("params")
    return telemetry(spark, sf).select("seq", params_text(p, "snake", "=").alias("snake"), params_text(p, "pascal", ": ").alias("pascal"))


@query("s10_params_text_full", ev_sql("""
SELECT seq, 'data=d' || k || ', k=' || k || ', key.path=' || key_path || ', pid=' || pid || ', status=' || status || ', value.type='
 || CASE WHEN seq % 3 = 0 THEN 'REG_BINARY' ELSE 'REG_SZ' END AS dotted FROM ev WHERE category = 'registry'"""))
def s10b(spark, sf):
    return telemetry(spark, sf).where("category = 'registry'").select("seq", params_text(F.col("params"), "dot", "=").alias("dotted"))


@query("s11_target_name", ev_sql("SELECT seq, strftime(ts, 'events-%Y.%m.%d-%y-%H') AS target FROM ev"))
def s11(spark, sf):
    return telemetry(spark, sf).select("seq", target_name(F.col("ts"), "events-%Y.%m.%d-%y-%H").alias("target"))


@query("s13_null_sink", ev_sql("SELECT count(*) AS discarded FROM ev"))
def s13(spark, sf):
    return spark.createDataFrame([(sinks.sink_counted(telemetry(spark, sf), "noop"),)], "discarded long")


@query("s14_sequence_number", ev_sql("""
SELECT seq AS event_id, host, CAST(count(*) FILTER (event_type <> 'view') OVER (PARTITION BY host ORDER BY ts, seq) AS BIGINT) AS number FROM ev"""))
def s14(spark, sf):
    name = F.when(F.col("event_type") == "view", F.lit("FileRundown")).otherwise(F.col("name"))
    df = telemetry(spark, sf).withColumn("name", name).withColumnRenamed("seq", "event_id")
    return events.with_seq(df, "ts", "event_id", out="number").select("event_id", "host", "number")


@query("s15_event_summary", ev_sql(r"""
SELECT seq, 'process with <code>' || pid || '</code> id ' || CASE name
  WHEN 'CreateFile' THEN lower(disposition) || 'ed a file <code>' || path || '</code>'
  WHEN 'ReadFile' THEN 'read <code>' || k || '</code> bytes from <code>' || path || '</code> file'
  WHEN 'CreateProcess' THEN 'spawned <code>' || path || '</code> process as <code>user' || (pid % 9) || '</code> user'
  WHEN 'RegSetValue' THEN 'set <code>' || key_path || '</code> value'
  ELSE 'connected to <code>' || dip || '</code> and <code>' || dport || '</code> port' END AS summary FROM ev"""))
def s15(spark, sf):
    return events.event_summary(telemetry(spark, sf)).select("seq", "summary")


@query("s15_event_summary_wide", ev_sql(r"""
SELECT seq, 'process with <code>' || pid || '</code> id ' || CASE seq % 8
  WHEN 0 THEN 'spawned a new thread with <code>' || tid || '</code> id at <code>' || (seq * 4096) || '</code> address'
  WHEN 1 THEN 'loaded </code>C:\Windows\System32\m' || (seq % 50) || CASE WHEN seq % 3 = 0 THEN '.sys' ELSE '.dll' END || '</code> module'
  WHEN 2 THEN 'created <code>' || CASE WHEN k % 2 = 0 THEN '\REGISTRY\USER\S-1-5-' || pid || '\Env' ELSE '\Device\HarddiskVolume' || (seq % 3) || '\d\f' || k END
    || '</code> handle of <code>' || CASE WHEN k % 2 = 0 THEN 'Key' ELSE 'File' END || '</code> type'
  WHEN 3 THEN 'allocated memory at <code>' || (seq * 4096) || '</code> address'
  WHEN 4 THEN 'sent <code>n' || k || '.example.com</code> DNS query'
  WHEN 5 THEN 'enqueued the work item to the thread pool'
  WHEN 6 THEN 'opened <code>' || path || '</code> process object with <code>' || (seq % 16) || '</code> access right(s)'
  ELSE 'opened <code>' || path || '</code> process'' thread object with <code>' || (seq % 16) || '</code> access right(s)' END AS summary FROM ev"""))
def s15b(spark, sf):
    return events.event_summary(wide_telemetry(spark, sf)).select("seq", "summary")
