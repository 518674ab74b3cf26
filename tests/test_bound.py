"""Steps that ask for equal values: pending events by value against lists and conditions, in batch and on a stream."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from huntline.operators.bound import Open, Terms
from huntline.operators.sequences import SequenceSpec, sequence_match, step
from huntline.streaming.run import drain
from huntline.streaming.sequence import sequence_stream

START = datetime(2024, 1, 1)


def kinds(*names):
    return lambda df: F.col("kind").isin(list(names))


SPECS = [
    SequenceSpec("two", [step(kinds("a"), alias="x"), step(kinds("b"), same={"v": "x.w"})], by="host", maxspan="20s"),
    SequenceSpec("middle", [step(kinds("a"), alias="x"), step(kinds("b", "a"), same={"w": "x.w"}), step(kinds("c"))], by="host", maxspan="15s"),
    SequenceSpec("both", [step(kinds("a"), alias="x"), step(kinds("b"), alias="y", same={"w": "x.w", "v": "x.v"}), step(kinds("c", "b"), same={"v": "y.w"})],
                 by="host", maxspan="40s", span="total", expire_when=kinds("end")),
]


def frame(spark, n=600, seed=1):
    rnd, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rnd.choice([0, 0, 1, 1, 2, 3, 60 if rnd.random() < 0.1 else 1])
        rows.append((f"h{i % 3 and 1}", i, START + timedelta(seconds=t), rnd.choice(["a", "a", "b", "c"] + ["end"] * (rnd.random() < 0.05)),
                     rnd.choice([None, 0.0, -0.0, 1.0, 2.0]), rnd.choice([None, 0.0, 1.0, 2.0, 3.0])))
    return spark.createDataFrame(rows, "host string, seq long, ts timestamp, kind string, v double, w double")


def found(df):
    return sorted((r.key, tuple(e.seq for e in r.events)) for r in df.collect())


def by_condition(spec):
    """The same sequence with its equalities as plain conditions, folded over lists."""
    return SequenceSpec(spec.name, [replace(s, same=()) for s in spec.steps], by=spec.by, maxspan=spec.maxspan, span=spec.span, expire_when=spec.expire_when)


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.name)
@pytest.mark.parametrize("limit", [2_000, 5])
def test_by_value_equals_conditions(spark, spec, limit):
    df = frame(spark)
    want = found(sequence_match(df, by_condition(spec), keep=["v", "w"]))
    assert spec.by_value and not by_condition(spec).by_value and want
    assert found(sequence_match(df, spec, keep=["v", "w"], rows_per_slice=limit)) == want


def test_small_arrow_batches_and_payloads(spark):
    df, spec = frame(spark), SPECS[2]
    want = sorted((r.key, r.events) for r in sequence_match(df, by_condition(spec), keep=["v", "w", "kind"]).collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.key, r.events) for r in sequence_match(df, spec, keep=["v", "w", "kind"]).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert str(got) == str(want)


def test_stream_equals_batch(spark, tmp_path):
    df, spec = frame(spark), SPECS[1]
    path = str(tmp_path / "in")
    last = spark.createDataFrame([("h9", 10_000, START + timedelta(days=9), "c", None, None)], df.schema)
    df.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(path)
    want = found(sequence_match(df, spec, keep=["v", "w"]))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = lambda: drain(sequence_stream(stream, spec, watermark="3650 days"), str(tmp_path / "out"))
    assert found(run()) == []
    far = last.withColumn("ts", F.lit(START + timedelta(days=9000)))
    far.write.mode("append").parquet(path)
    assert found(run()) == want


def test_stream_with_a_bounded_watermark_lets_go(spark, tmp_path):
    spec = SPECS[0]
    schema = "host string, seq long, ts timestamp, kind string, v double, w double"
    at = lambda s: START + timedelta(seconds=s)
    parts = [[("h", 1, at(0), "a", None, 1.0), ("h", 2, at(5), "a", None, 2.0)], [("h", 3, at(10), "b", 2.0, None), ("h", 4, at(12), "a", None, 3.0)],
             [("h", 5, at(40), "b", 3.0, None)], [("h", 6, at(2), "b", 1.0, None)], [("h", 7, at(500), "c", None, None)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        out = drain(sequence_stream(stream, spec, watermark="1 second"), str(tmp_path / "out"))
    # 2 and 3 agree; 4 has expired when 5 comes; 6 is late.
    assert found(out) == [("h", (2, 3))]


def test_rows_with_missing_values_and_no_rows(spark):
    df = frame(spark, 50).withColumn("w", F.lit(None).cast("double"))
    assert found(sequence_match(df, SPECS[0], keep=["v", "w"])) == []
    assert found(sequence_match(df.limit(0), SPECS[0], keep=["v", "w"])) == []


def test_same_is_checked():
    with pytest.raises(ValueError, match="one earlier step"):
        step(kinds("a"), same={"v": "x.v", "w": "y.w"})
    with pytest.raises(ValueError, match="not both"):
        step(kinds("a"), same={"v": "x.v"}, uses=["x"])


def test_pending_events_cost_one_look_each():
    looks = 0

    class Counted(dict):
        def get(self, at, default=None):
            nonlocal looks
            looks += 1
            return super().get(at, default)

    state, n = Open(Terms(2, False, 10**9, ((1, 0),)), Counted()), 100_000
    for i in range(n):
        assert state.take(2 * i, 1, False, [None], [str(i)], i) is None
        assert state.take(2 * i + 1, 2, False, [f"x{i}"], [None], -i) is None
    assert state.take(2 * n, 2, False, ["777"], [None], n) == [777, n]
    assert looks <= 2 * n + 1
