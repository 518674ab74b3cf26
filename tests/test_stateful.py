"""Sequences, as-of joins and streams against straightforward loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from huntline.operators.asof import asof_join, pair_latest
from huntline.operators.sequences import SequenceSpec, sequence_match, step
from huntline.sources.capture import replay_capture, write_capture
from huntline.sources.tables import derive, table, telemetry
from huntline.streaming.joins import pair_callstack_stream, pair_set_value_stream
from huntline.streaming.run import drain
from huntline.streaming.sequence import IDLE, advance, sequence_stream

START = datetime(2024, 1, 1)


def rows(n=600, keys=3, seed=1, kinds="abcx"):
    rnd = random.Random(seed)
    out, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 5, 30])
        # One key holds most of the rows.
        out.append((i, START + timedelta(seconds=t), "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(keys)}", rnd.choice(kinds), rnd.randrange(100)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "seq bigint, ts timestamp, key string, kind string, v int")


def is_kind(*names):
    return lambda df: F.col("kind").isin(list(names))


SPECS = [
    SequenceSpec("two", [step(is_kind("a")), step(is_kind("b"))], by="key", maxspan="1m"),
    SequenceSpec("three", [step(is_kind("a")), step(is_kind("a", "b")), step(is_kind("c"))], by="key", maxspan="2m"),
    SequenceSpec("total", [step(is_kind("a")), step(is_kind("b")), step(is_kind("c"))], by="key", maxspan="1m30s", span="total"),
    SequenceSpec("any order", [step(is_kind("a")), step(is_kind("b")), step(is_kind("c"))], by="key", maxspan="1m", ordered=False),
    SequenceSpec("expiring", [step(is_kind("a")), step(is_kind("b"))], by="key", maxspan="5m", expire_when=is_kind("x")),
]
STEPS = {"two": ["a", "b"], "three": ["a", "ab", "c"], "total": ["a", "b", "c"], "any order": ["a", "b", "c"], "expiring": ["a", "b"]}


def looped(data, spec):
    """The automaton row by row."""
    found, states = set(), {}
    for seq, ts, key, kind, _ in sorted(data, key=lambda r: (r[1], r[0])):
        mask = sum(1 << i for i, kinds in enumerate(STEPS[spec.name]) if kind in kinds)
        ends = spec.expire_when is not None and kind == "x"
        if mask or ends:
            t = int((ts - START).total_seconds() * 1_000_000) + 1
            states[key], done = advance(states.get(key, IDLE), (t, seq, mask, ends), spec)
            if done:
                found.add((spec.name, key, tuple(done[1])))
    return found


def matched(df):
    return {(r.rule, r.key, tuple(e.seq for e in r.events)) for r in df.select("rule", "key", "events").collect()}


@pytest.mark.parametrize("limit", [200_000, 7, 50])
def test_sequences_equal_a_loop(spark, limit):
    data = rows()
    expected = set().union(*[looped(data, s) for s in SPECS])
    assert len(expected) > 50
    assert matched(sequence_match(frame(spark, data), SPECS, rows_per_slice=limit)) == expected


@pytest.mark.parametrize("limit", [200_000, 20])
def test_bound_fields(spark, limit):
    data = rows(300, seed=5)
    spec = SequenceSpec("bound", [step(is_kind("a"), alias="e"), step(is_kind("b"), bound=lambda cur, b: cur["v"] > b["e"]["v"] + 40, uses=["e"])],
                        by="key", maxspan="5m")
    expected, pending, entered = set(), {}, {}
    for seq, ts, key, kind, v in sorted(data, key=lambda r: (r[1], r[0])):
        held = pending.setdefault(key, [])
        if kind not in "ab":
            continue
        if held and ts - entered[key] > timedelta(minutes=5):
            held.clear()
        last = held[-1][2] if held else None
        if kind == "a" and (last is None or ts > last):
            entered.setdefault(key, ts)
            if not held:
                entered[key] = ts
            held.append((seq, v, ts))
        elif kind == "b" and held and ts > last:
            fit = [p for p in held if v > p[1] + 40]
            if fit:
                expected.add(("bound", key, (fit[0][0], seq)))
                held.clear()
    assert expected
    assert matched(sequence_match(frame(spark, data), spec, keep=["v"], rows_per_slice=limit)) == expected


def test_spec_checks():
    one, two = step(is_kind("a")), step(is_kind("b"))
    for bad in (dict(steps=[one]), dict(steps=[one] * 6), dict(steps=[one, two], maxspan="5h"), dict(steps=[step(is_kind("a"), by="key"), two]),
                dict(steps=[step(is_kind("a"), by="x"), step(is_kind("b"), by="y")], by="key"),
                dict(steps=[one, step(is_kind("b"), bound=lambda c, b: c["v"] > 1, uses=["nobody"])])):
        with pytest.raises(ValueError):
            SequenceSpec("bad", **bad)


def expected_asof(left, state, close, grace):
    out = {}
    for seq, ts, key, *_ in left:
        opened = [s for s in state if s[2] == key and s[1] <= ts]
        ended = [c for c in close if c[2] == key and c[1] + grace < ts]
        best = max(opened, key=lambda s: (s[1], s[0]), default=None)
        if best and ended and max(c[1] for c in ended) >= best[1]:
            best = None
        out[seq] = best[0] if best else None
    return out


@pytest.mark.parametrize("options", [{}, {"slice_width": "1m"}, {"slice_width": "2h"}])
def test_asof_equals_a_loop(spark, options):
    data = rows(400, seed=3)
    left, state, close = ([r for r in data if r[3] == k] for k in "abc")
    f = lambda d: frame(spark, d)
    states = f(state).withColumn("sid", F.col("seq"))
    out = asof_join(f(left), states, ["key"], "ts", ["sid"], close=f(close), grace="5s", tie="sid", **options)
    assert {r.seq: r.sid for r in out.collect()} == expected_asof(left, state, close, timedelta(seconds=5))


def test_asof_cuts_hot_keys(spark, monkeypatch):
    from huntline.operators import asof
    data = rows(400, seed=4)
    left, state = [r for r in data if r[3] == "a"], [r for r in data if r[3] == "b"]
    monkeypatch.setattr(asof.last_at_or_before, "__defaults__", (*asof.last_at_or_before.__defaults__[:-1], 15))
    states = frame(spark, state).withColumn("sid", F.col("seq"))
    out = asof_join(frame(spark, left), states, ["key"], "ts", ["sid"], tie="sid")
    assert "_w" in out._jdf.queryExecution().logical().toString()
    assert {r.seq: r.sid for r in out.collect()} == expected_asof(left, state, [], timedelta(0))


def test_pairing_is_one_to_one(spark):
    data = rows(300, seed=9)
    left, right = [r for r in data if r[3] == "a"], [r for r in data if r[3] == "b"]
    out = pair_latest(frame(spark, left), frame(spark, right).withColumn("rid", F.col("seq")), ["key"], "ts", "1m", ["rid"])
    used = [r.rid for r in out.collect() if r.rid is not None]
    assert used and len(used) == len(set(used)) and out.count() == len(left)


@pytest.fixture(scope="module")
def split_folder(spark, small, tmp_path_factory):
    """The event table as ten time-ordered files."""
    folder = tmp_path_factory.mktemp("stream")
    pdf = table(spark, small, "events").orderBy("ts").toPandas()
    step_ = len(pdf) // 10
    for i in range(10):
        pdf.iloc[i * step_:(i + 1) * step_ if i < 9 else None].to_parquet(folder / f"events{i:02d}.parquet", coerce_timestamps="us", index=False)
    return str(folder)


def stream_of(spark, folder, small):
    return derive(spark.readStream.schema(table(spark, small, "events").schema).option("maxFilesPerTrigger", 1).parquet(folder))


def test_stream_sequences_equal_batch(spark, small, split_folder, tmp_path):
    def kind(name):
        return lambda df: F.col("event_type") == name
    spec = SequenceSpec("pair", [step(kind("error")), step(kind("purchase"))], by="host", maxspan="4h")
    got = drain(sequence_stream(stream_of(spark, split_folder, small), spec, watermark="0 seconds"), str(tmp_path / "s"))
    assert matched(got) == matched(sequence_match(telemetry(spark, small), spec))


def test_stream_set_value_pairs(spark, small, split_folder, tmp_path):
    """Over time-ordered files with a bounded watermark: the pairs of the batch operator, each internal write used once."""
    def sides(df):
        writes = df.where("event_type = 'purchase'").select("seq", "host", "pid", "ts", (F.col("seq") % 2).alias("value_name"))
        internal = df.where("event_type = 'signup'").select("seq", "host", "pid", "ts", (F.col("seq") % 2).alias("value_name"), F.lit("REG_SZ").alias("value_type"),
                                                            F.col("seq").cast("string").alias("data"))
        return writes, internal
    out = drain(pair_set_value_stream(*sides(stream_of(spark, split_folder, small)), ttl="8h", delay="1 minute"), str(tmp_path / "p"))
    got = {r.seq: r.data for r in out.collect()}
    want = {r.seq: r.data for r in pair_latest(*sides(telemetry(spark, small)), ["host", "pid"], "ts", "8h", ["data"], same=["value_name"]).collect()}
    assert any(got.values()) and len(got) > 0.9 * len(want)  # the last writes wait for the watermark
    assert all(want[s] == d for s, d in got.items())
    assert len([d for d in got.values() if d]) == len({d for d in got.values() if d})


def test_stream_pairing_keeps_hosts_apart_and_uses_marks_once(spark, tmp_path):
    at = lambda ms: START + timedelta(milliseconds=ms)
    events = [("a", 1, at(0), 7), ("a", 2, at(100), 7), ("b", 3, at(0), 7), ("b", 4, at(60_000), 7), ("c", 5, at(0), None), ("d", 6, at(0), 7), ("late", 9, at(600_000), 8)]
    walks = [("a", at(10), 7, "s1"), ("a", at(20), 7, "s2"), ("a", at(30), 7, "s3"), ("b", at(59_800), 7, "b2"), ("d", at(501), 7, "too late"), ("late", at(600_000), 8, "x")]
    e, w = str(tmp_path / "e"), str(tmp_path / "w")
    spark.createDataFrame(events, "host string, seq long, ts timestamp, stack_id long").write.parquet(e)
    spark.createDataFrame(walks, "host string, ts timestamp, stack_id long, callstack string").write.parquet(w)
    stream = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = drain(pair_callstack_stream(stream(e), stream(w), delay="1 second"), str(tmp_path / "o"))
    assert {(r.host, r.seq, r.callstack) for r in out.collect()} >= {("a", 1, "s1"), ("a", 2, "s2"), ("b", 3, None), ("b", 4, "b2"), ("c", 5, None), ("d", 6, None)}
    assert out.where("seq < 9").count() == 6


def test_stream_pairing_releases_unmatched(spark, small, split_folder, tmp_path):
    df = stream_of(spark, split_folder, small)
    events = df.select("seq", "host", "ts", F.col("seq").alias("stack_id"))
    walks = df.where("seq % 2 = 0").select("host", F.col("seq").alias("stack_id"), "ts", F.lit("st").alias("callstack"))
    out = drain(pair_callstack_stream(events, walks, delay="0 seconds"), str(tmp_path / "c"))
    seen = {r.seq: r.callstack for r in out.collect()}
    assert len(seen) >= 990 and all((s == "st") == (i % 2 == 0) for i, s in seen.items())


def test_stream_pairs_one_by_one_like_the_batch():
    """Any split of rows into timer calls gives what one call gives."""
    from huntline.streaming.pairing import LEFT, RIGHT, meet_newest, meet_oldest
    rnd = random.Random(6)
    for _ in range(200):
        rows_ = sorted((rnd.randrange(60), rnd.choice([LEFT, RIGHT]), i, str(i % 2), f"p{i}") for i in range(30))
        for meet in (meet_newest, meet_oldest):
            whole = meet([], rows_, 9)
            waiting, out = [], []
            cut = sorted(rnd.randrange(31) for _ in range(4))
            for a, b in zip([0, *cut], [*cut, 30]):
                waiting, more = meet(waiting, rows_[a:b], 9)
                out += more
            assert (waiting, out) == whole
            used = [f for _, f in out if f]
            assert len(used) == len(set(used))


def test_capture_round_trip(spark, small, tmp_path):
    path = str(tmp_path / "cap")
    df = telemetry(spark, small)
    stats = write_capture(df, df.limit(3).select("seq"), path)
    assert stats["events"] == df.count() and stats["bytes"] > 0 and stats["processes"] == df.where("name = 'CreateProcess'").count()
    back = replay_capture(spark, path, where=lambda d: F.col("category") == "net")
    assert back.count() == df.where("category = 'net'").count()
    assert "PartitionFilters: [isnotnull(category" in back._jdf.queryExecution().executedPlan().toString()
