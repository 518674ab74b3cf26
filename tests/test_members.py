"""Members open at event time against a loop, with keys that fill several ranges."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from huntline.operators.enrich import members_asof

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_against_a_loop(spark, partitions):
    rnd = random.Random(3)
    key = lambda: rnd.choice(["hot"] * 6 + ["b", "c", None])
    at = lambda: T0 + dt.timedelta(seconds=rnd.randrange(300))
    changes = [(key(), f"m{rnd.randrange(6)}", rnd.choice([None, 1, 2]), at(), rnd.random() < 0.5) for _ in range(400)]
    changes += [("hot", "always", 1, T0, True), ("hot", "never", 1, T0, False)]
    events = [(i, key(), at(), {"k": "v"}) for i in range(300)]
    events += events[:5]
    schema = "key string, member string, part int, ts timestamp, opens boolean"
    df = spark.createDataFrame(changes, schema).repartition(4)
    left = spark.createDataFrame(events, "seq long, key string, ts timestamp, params map<string,string>").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = members_asof(left, df.where("opens"), df.where("not opens"), ["key"], ["member", "part"])
        assert out.columns == [*left.columns, "members"]
        got = sorted((r.seq, sorted(map(str, map(tuple, r.members)))) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for seq, k, t, _ in events:
        members = []
        for m in {(c[1], c[2]) for c in changes if c[0] == k and k is not None}:
            before = [c for c in changes if (c[0], c[1], c[2]) == (k, *m) and c[3] <= t]
            if before and any(c[4] for c in before if c[3] == max(b[3] for b in before)):
                members.append(str(m))
        want.append((seq, sorted(members)))
    assert got == sorted(want)
    assert any(len(m) > 3 for _, m in got)


def test_no_changes_and_no_events(spark):
    none = spark.createDataFrame([], "key string, member string, ts timestamp")
    left = spark.createDataFrame([(1, "a", T0)], "seq long, key string, ts timestamp")
    assert [tuple(r) for r in members_asof(left, none, none, ["key"], ["member"]).collect()] == [(1, "a", T0, [])]
    assert members_asof(left.limit(0), none, none, ["key"], ["member"]).count() == 0
