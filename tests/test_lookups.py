"""Several keys of an event looked up in several tables in one pass."""

from __future__ import annotations

import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from huntline.operators import asof, enrich
from huntline.operators.asof import Source, asof_join, lookups

T0 = dt.datetime(2024, 1, 1)


def when():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def at(s):
    return T0 + dt.timedelta(seconds=s)


def data(n=300, seed=1):
    rnd = random.Random(seed)
    key = lambda: rnd.choice([None, 1, 1, 1, 1, 2, 3, 4])
    host = lambda: rnd.choice(["a", "a", "b", None])
    events = [(i, host(), key(), key(), at(rnd.randrange(500)), {"p": str(i % 5)}) for i in range(n)]
    states = [(host(), key(), at(rnd.randrange(500)), f"s{i}", i) for i in range(n // 3)]
    ends = [(host(), key(), at(rnd.randrange(500))) for _ in range(n // 8)]
    others = [(host(), key(), at(rnd.randrange(500)), f"o{i}", i) for i in range(n // 6)]
    return events + events[:7], states, ends, others


def brute(events, states, ends, others, grace):
    def last(rows, h, k, t):
        fit = [r for r in rows if h is not None and k is not None and (r[0], r[1]) == (h, k) and r[2] <= t]
        return max(fit, key=lambda r: (r[2], r[4]), default=None)

    out = []
    for seq, h, x, y, t, _ in events:
        row = [seq]
        for k in (x, y):
            s = last(states, h, k, t)
            over = max((e[2] for e in ends if (e[0], e[1]) == (h, k) and e[2] + grace < t), default=None)
            row += [s[3] if s and (over is None or over < s[2]) else None, (last(others, h, k, t) or [None] * 4)[3]]
        out.append(tuple(row))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"slice_width": 60_000_000}, {"slice_width": 7_000_000_000}, {"rows_per_slice": 40}])
def test_against_brute_force(spark, options):
    events, states, ends, others = data()
    schema = "host string, k long, ts timestamp, name string, no long"
    left = spark.createDataFrame(events, "seq long, host string, x long, y long, ts timestamp, params map<string,string>").repartition(5)
    sources = {"s": Source(spark.createDataFrame(states, schema), ["host", "k"], when(), ["name"], tie="no", ends=spark.createDataFrame(ends, "host string, k long, ts timestamp"), ends_at=when(), grace=5_000_000),
               "o": Source(spark.createDataFrame(others, schema), ["host", "k"], when(), ["name"], tie="no")}
    out = lookups(left, when(), {"x": ["host", "x"], "y": ["host", "y"]}, sources, **options)
    assert out.columns == [*left.columns, "x_s", "x_o", "y_s", "y_o"]
    got = [(r.seq, *(r[c].name if r[c] else None for c in ("x_s", "x_o", "y_s", "y_o"))) for r in out.collect()]
    assert sorted(got, key=str) == brute(events, states, ends, others, dt.timedelta(seconds=5))


def test_empty_sides(spark):
    left = spark.createDataFrame([(1, 2, T0)], "x long, y long, ts timestamp")
    none = spark.createDataFrame([], "k long, ts timestamp, name string")
    found = lookups(left, when(), {"x": ["x"], "y": ["y"]}, {"s": Source(none, ["k"], when(), ["name"])})
    assert [tuple(r) for r in found.collect()] == [(1, 2, T0, None, None)]
    assert lookups(left.limit(0), when(), {"x": ["x"]}, {"s": Source(none, ["k"], when(), ["name"])}).count() == 0


def scans(df, path):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lookups")
    for name, cols in {"events": "host string, file_key long, file_object long, ts timestamp, seq long", "opened": "host string, file_object long, ts timestamp, path string, type string"}.items():
        spark.createDataFrame([], cols).write.parquet(f"{folder}/{name}")
    return folder


def test_events_are_read_once_whatever_the_lookups(spark, stored):
    events, opened = (spark.read.parquet(f"{stored}/{n}") for n in ("events", "opened"))
    found = enrich.enrich_file_path(events, opened, opened.select("host", "file_object", "ts"), opened)
    assert scans(found, "events") == 4  # events, opened, closed, handles
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2
    assert "Join" not in text


def test_chained_lookups_read_their_input_once(spark, stored):
    events = spark.read.parquet(f"{stored}/events")
    states = spark.read.parquet(f"{stored}/opened")
    out = events
    for i in range(3):
        out = asof_join(out, states.withColumnRenamed("path", f"p{i}"), ["host", "file_object"], "ts", [f"p{i}"])
        assert scans(out, "events") == 2 + i


def test_hot_keys_are_cut(spark, monkeypatch):
    monkeypatch.setattr(asof, "ROWS_PER_SLICE", 50)
    left = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").alias("other"), F.timestamp_seconds(F.col("id")).alias("ts"))
    states = spark.range(2000).where("id % 7 = 0").select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("sid"))
    out = lookups(left, when(), {"x": ["k"]}, {"s": Source(states, ["k"], when(), ["sid"])}, rows_per_slice=50)
    for r in out.collect():
        t = r.other
        want = max((i for i in range(0, t + 1, 7) if i % 2 == r.k), default=None)
        assert (r.x_s.sid if r.x_s else None) == want


def test_names_and_file_facts_keep_hosts_apart(spark):
    events = spark.createDataFrame([("a", at(9), "1.1.1.1", "2.2.2.2"), ("b", at(9), "1.1.1.1", "2.2.2.2"), ("b", at(9), None, None)], "host string, ts timestamp, sip string, dip string")
    names = spark.createDataFrame([("a", "1.1.1.1", ["one"], at(1)), ("b", "1.1.1.1", ["other"], at(2)), ("a", "2.2.2.2", ["old"], at(-7200))], "host string, ip string, names array<string>, valid_from timestamp")
    got = sorted((r.host, r.sip_names, r.dip_names) for r in enrich.enrich_names(events, names).collect() if r.sip)
    assert got == [("a", ["one"], None), ("b", ["other"], None)]
    files = spark.createDataFrame([(h, at(9), "CreateFile", "C:\\X.dll", "CREATE", "Success") for h in "ab"], "host string, ts timestamp, name string, file_path string, operation string, status string")
    meta = spark.createDataFrame([("a", "c:\\x.dll", at(1), True, False, False), ("b", "c:\\x.dll", at(1), False, True, False)], "host string, path string, valid_from timestamp, is_dll boolean, is_driver boolean, is_exec boolean")
    gone = spark.createDataFrame([("b", "C:\\x.dll", at(20))], "host string, path string, ts timestamp")
    assert sorted((r.host, r.is_dll, r.is_driver) for r in enrich.enrich_file_meta(files, meta, gone).collect()) == [("a", True, False), ("b", False, True)]
