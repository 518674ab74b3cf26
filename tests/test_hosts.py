"""Two hosts that use the same sequence numbers, pids and keys; rows without keys; deep and cyclic trees."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from huntline.operators import enrich, scanning
from huntline.operators.alerts import build_alerts
from huntline.operators.asof import asof_join, pair_latest
from huntline.operators.rules import Rule

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def test_pairing_keeps_hosts_apart(spark):
    left = spark.createDataFrame([("a", 1, 7, at(10), "v"), ("b", 1, 7, at(20), "v")], "host string, pid int, seq long, ts timestamp, value_name string")
    right = spark.createDataFrame([("a", 1, 5, at(1), "v", "A"), ("b", 1, 5, at(2), "v", "B")], "host string, pid int, seq long, ts timestamp, value_name string, data string")
    got = pair_latest(left, right, ["host", "pid"], "ts", "2m", ["data"], same=["value_name"]).collect()
    assert sorted((r.host, r.data) for r in got) == [("a", "A"), ("b", "B")]


def test_registry_paths_keep_hosts_apart(spark):
    events = spark.createDataFrame([("a", 1, 7, at(5), None, "Run"), ("b", 1, 7, at(5), None, "Run")], "host string, pid int, seq long, ts timestamp, kcb long, relative_key string")
    kcbs = spark.createDataFrame([], "host string, kcb long, ts timestamp, base_key string")
    handles = spark.createDataFrame([("a", 1, "HKLM\\A\\Run"), ("b", 1, "HKLM\\B\\Run")], "host string, pid int, handle_name string")
    got = enrich.enrich_registry_path(events, kcbs, kcbs.select("host", "kcb", "ts"), handles).collect()
    assert len(got) == 2 and {r.host: r.key_path[-5:] for r in got} == {"a": "A\\Run", "b": "B\\Run"}


def test_one_walk_per_event_and_one_event_per_walk(spark):
    events = spark.createDataFrame([("a", 1, at(0), 9), ("a", 2, at(100), 9), ("b", 1, at(0), 9), ("b", 2, at(0), None)], "host string, seq long, ts timestamp, stack_id long")
    walks = spark.createDataFrame([("a", 9, at(10), "s1"), ("a", 9, at(20), "s2"), ("a", 9, at(30), "s3"), ("b", 9, at(900), "late")], "host string, stack_id long, ts timestamp, callstack string")
    got = enrich.pair_callstack(events, walks).collect()
    assert sorted((r.host, r.seq, r.callstack) for r in got) == [("a", 1, "s1"), ("a", 2, "s2"), ("b", 1, None), ("b", 2, None)]


def test_hits_count_once_per_host_and_process(spark):
    hits = spark.createDataFrame([("a", 1, 3, "alloc"), ("a", 1, 4, "alloc"), ("b", 1, 3, "alloc"), ("b", 1, 9, "module")], "host string, pid int, seq long, trigger string")
    assert sorted((r.host, r.seq) for r in scanning.once_per_process(hits).collect()) == [("a", 3), ("b", 3), ("b", 9)]


def test_alert_ids_differ_between_hosts(spark):
    matches = spark.createDataFrame([("r", "a"), ("r", "b")], "rule_id string, host string").select(
        "rule_id", F.array(F.struct("host", F.lit(1).cast("long").alias("seq"), F.lit("n").alias("name"))).alias("events"))
    got = build_alerts(matches, [Rule("r", "rule", lambda d: F.lit(True), output="seen")]).collect()
    assert len({r.alert_id for r in got}) == 2 and {r.text for r in got} == {"seen"}


def test_rows_without_a_key_do_not_meet(spark):
    n = 20_000
    left = spark.range(n).select(F.when(F.col("id") % 10 == 0, F.col("id") % 50).alias("k"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.col("id").alias("seq"))
    right = spark.range(50).select(F.col("id").alias("k"), F.lit(T0).cast("timestamp").alias("ts"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("state"))
    got = asof_join(left, right, ["k"], "ts", ["state"])
    assert got.count() == n
    assert got.where("k is null and state is not null or k is not null and state <> concat('s', k)").isEmpty()
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < n / 3


@pytest.mark.parametrize("depth", [3, 100])
def test_ancestors_reach_the_root_and_stop_in_a_cycle(spark, depth):
    rows = [(i, i - 1 if i else None, f"p{i}") for i in range(depth)] + [(1000, 1001, "x"), (1001, 1002, "y"), (1002, 1001, "z"), (1003, 1003, "me"), (1004, 77777, "lost")]
    got = {r.uuid: r.ancestors for r in enrich.ancestors(spark.createDataFrame(rows, "uuid long, parent_uuid long, name string")).collect()}
    assert got[depth - 1] == [f"p{i}" for i in range(depth - 2, -1, -1)]
    assert (got[1000], got[1001], got[1002], got[1003], got[1004]) == (["y", "z"], ["z"], ["y"], [], [])


def test_stale_walks_unpaired_events_and_reused_marks(spark):
    at = lambda ms: dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)
    events = [("stale", 1, 20_000), ("alone", 1, 0), ("alone", 2, 10_000), ("chain", 1, 0), ("chain", 2, 450), ("reused", 1, 0), ("reused", 2, 60_000), ("late", 1, 0), ("twice", 1, 0), ("twice", 2, 0)]
    walks = [("stale", 10_000, "old"), ("stale", 20_000, "s"), ("alone", 10_000, "a"), ("chain", 900, "c"), ("reused", 100, "r1"), ("reused", 59_800, "r2"), ("late", 501, "l"), ("twice", 500, "t")]
    e = spark.createDataFrame([(h, s, at(t), "n", 7, {"k": "v"}) for h, s, t in events], "host string, seq long, ts timestamp, name string, stack_id long, params map<string,string>")
    w = spark.createDataFrame([(h, 7, at(t), c) for h, t, c in walks], "host string, stack_id long, ts timestamp, callstack string")
    got = enrich.pair_callstack(e, w)
    assert got.columns == [*e.columns, "callstack"]
    assert sorted((r.host, r.seq, r.callstack or "") for r in got.collect()) == [
        ("alone", 1, ""), ("alone", 2, "a"), ("chain", 1, ""), ("chain", 2, "c"), ("late", 1, ""), ("reused", 1, "r1"), ("reused", 2, "r2"), ("stale", 1, "s"), ("twice", 1, "t"), ("twice", 2, "")]
