"""Counters, statistics, sorting and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import common
from ..operators import reports as R
from ..schema import EVENT_NAMES
from ..sources.tables import table, telemetry, wide_telemetry
from .registry import ev_sql, query

NTZ = "timestamp_ntz"


def _ntz(df, column="interval_start"):
    return df.withColumn(column, F.col(column).cast(NTZ))


@query("a1_count_by_interval", ev_sql("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS interval_start, key_path AS key, count(*) AS n FROM ev WHERE category = 'registry' GROUP BY ALL"))
def a1(spark, sf):
    df = telemetry(spark, sf).where("category = 'registry'")
    return _ntz(R.count_by(df, F.col("params")["key_path"], "6 hours"))


@query("a1_cumulative_counter", ev_sql("""
SELECT interval_start, key, CAST(sum(n) OVER (PARTITION BY key ORDER BY interval_start) AS BIGINT) AS n FROM (
 SELECT date_trunc('day', ts) AS interval_start, host AS key, count(*) AS n FROM ev GROUP BY ALL)"""))
def a1b(spark, sf):
    return _ntz(R.count_by(telemetry(spark, sf), "host", "1 day", cumulative=True))


@query("a4_counters", ev_sql("""
SELECT count(*) AS processed, count(*) FILTER (pid % 5 = 0) AS excluded, count(*) FILTER (name = 'Connect') AS unknown, count(*) FILTER (status <> 'Success') AS failed,
 count(*) FILTER (evasions % 2 = 1) AS direct_syscalls, count(*) FILTER (evasions >= 2) AS indirect_syscalls FROM ev"""))
def a4(spark, sf):
    known = [n for names in EVENT_NAMES.values() for n in names if n != "Connect"]
    return R.pipeline_counters(telemetry(spark, sf), known, F.col("pid") % 5 == 0, F.col("params")["status"] != "Success")


@query("a5_capture_statistics", ev_sql("SELECT count(*) AS events, CAST(sum(length(path)) AS BIGINT) AS bytes, count(*) FILTER (name = 'CreateProcess') AS processes, CAST(0 AS BIGINT) AS handles FROM ev"))
def a5(spark, sf):
    return R.capture_stats(telemetry(spark, sf), F.octet_length("path"))


@query("a7_distinct_modules", ev_sql(r"""
SELECT 'm' || (seq % 50) || CASE WHEN seq % 3 = 0 THEN '.sys' ELSE '.dll' END AS name, 'C:\Windows\System32\m' || (seq % 50) || CASE WHEN seq % 3 = 0 THEN '.sys' ELSE '.dll' END AS path
FROM ev WHERE seq % 8 = 1 GROUP BY ALL"""))
def a7(spark, sf):
    mods = wide_telemetry(spark, sf).where("name = 'LoadModule'").select(F.col("params")["file_path"].alias("path"))
    return R.distinct_modules(mods)


@query("w1_delta", ev_sql("SELECT seq, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY host ORDER BY ts, seq)) AS delta_us FROM ev"))
def w1(spark, sf):
    return R.with_delta(telemetry(spark, sf).select("seq", "ts", "host")).select("seq", "delta_us")


@query("t1_sort", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL ORDER BY n DESC")
def t1(spark, sf):
    return R.sort_rows(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")), ["n"], descending=True)


@query("t2_top_rows", ev_sql("SELECT pid, count(*) AS n FROM ev GROUP BY pid ORDER BY n DESC, pid LIMIT 10"))
def t2(spark, sf):
    return R.top(telemetry(spark, sf).groupBy("pid").agg(F.count("*").alias("n")), "n", 10, ["pid"])


@query("t6_catalogue_order", ev_sql("SELECT DISTINCT name, category FROM ev"))
def t6(spark, sf):
    return R.catalogue_order(telemetry(spark, sf).select("name", "category"))


@query("u3_array_intersection", "SELECT p_partkey, array_to_string(list_sort(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'bolt'])), ',') AS common FROM part")
def u3(spark, sf):
    hit = common(F.split("p_name", " "), ["red", "ring", "bolt"])
    return table(spark, sf, "part").select("p_partkey", F.array_join(hit, ",").alias("common"))


@query("m1_report", ev_sql("""
SELECT date_trunc('day', ts) AS interval_start, dip AS key, count(*) AS n FROM ev WHERE category = 'net' GROUP BY ALL ORDER BY n DESC, interval_start, key LIMIT 20"""))
def m1(spark, sf):
    report = R.Report(key=F.col("params")["dip"], where=lambda d: F.col("category") == "net", every="1 day", max_rows=20, title="Top destinations")
    return _ntz(report.run(telemetry(spark, sf)))


@query("m2_program_alert", ev_sql("SELECT 'Busy key' AS title, key || ' changed ' || n || ' times' AS text, 'medium' AS severity FROM (SELECT key_path AS key, count(*) AS n FROM ev WHERE category = 'registry' GROUP BY 1) WHERE n > 5"))
def m2(spark, sf):
    busy = telemetry(spark, sf).where("category = 'registry'").groupBy(F.col("params")["key_path"].alias("key")).agg(F.count("*").alias("n")).where("n > 5")
    text = F.concat(F.col("key"), F.lit(" changed "), F.col("n").cast("string"), F.lit(" times"))
    return R.program_alerts(busy, "Busy key", text, tags=["registry"]).select("title", "text", "severity")


@query("m3_watch_files", ev_sql("SELECT '' AS process, path FROM ev WHERE name = 'CreateFile' AND disposition <> 'OPEN'"))
def m3(spark, sf):
    return R.watch_files(telemetry(spark, sf))
