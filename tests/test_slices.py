"""Slices of hot sequence keys as functions of their entry."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntline.operators import sequences
from huntline.operators.sequences import SequenceSpec, sequence_match, step
from huntline.operators.slices import Rule, Slice, State

START = datetime(2024, 1, 1)


def run(rule: Rule, rows, state=None):
    """The automaton row by row; state is (filled, entered, started, refs, last)."""
    full, done = (1 << rule.steps) - 1, []
    for ref, t, mask, ends in rows:
        if state and (ends or t - (state[2] if rule.total else state[1]) > rule.span):
            state = None
        filled, last = (state[0], state[4]) if state else (0, None)
        if rule.ordered:
            open_bits = mask & (filled * 2 + 1)
            hit = open_bits & -open_bits if not state or t > last else 0
            new = hit if hit == filled + 1 else 0
        else:
            hit, new = mask, mask & ~filled
        if hit or new:
            if new:
                state = (filled | new, t, state[2] if state else t, (*(state[3] if state else ()), ref), t)
            elif state:
                state = (*state[:4], t)
        if state and state[0] == full:
            done.append(state[3])
            state = None
    return state, done


def plain(state):
    return None if state is None else State(*state[:4])


RULES = [Rule(2, True, False, 10), Rule(3, True, False, 7), Rule(3, True, True, 12), Rule(4, True, True, 30), Rule(2, False, False, 9), Rule(3, False, True, 11), Rule(3, False, False, 6)]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("seed", range(12))
def test_effects_compose_to_the_whole(rule, seed):
    rnd = random.Random(f"{rule}{seed}")
    rare = rnd.random() < 0.4
    t, ts = 0, []
    for _ in range(120):
        t += rnd.choice([0, 0, 1, 1, 2, 5])
        ts.append(t)
    mask = [1 << rnd.randrange(rule.steps) if rnd.random() < 0.8 else rnd.randrange(1 << rule.steps) for _ in ts]
    if rare:  # hardly anything completes, so open states run through many slices
        mask = [m & 3 if rnd.random() < 0.1 else m & 1 for m in mask]
    ends = [rnd.random() < 0.03 for _ in ts]
    edges = [0]
    while edges[-1] < len(ts):
        end = min(len(ts), edges[-1] + rnd.randrange(1, 14))
        while end < len(ts) and ts[end] == ts[end - 1]:
            end += 1
        edges.append(end)
    slices = [(a, b) for a, b in zip(edges, edges[1:])]
    rows = [((0, n, i - a), ts[i], mask[i], ends[i]) for n, (a, b) in enumerate(slices) for i in range(a, b)]
    effects = [Slice(rule, (0, n), np.array(ts[a:b]), np.array(mask[a:b]), np.array(ends[a:b])).effect() for n, (a, b) in enumerate(slices)]
    effects = [type(e).unpack(e.pack()) for e in effects]

    state = None
    for effect, (a, b) in zip(effects, slices):
        entry, (state, _) = plain(state), run(rule, rows[a:b], state)
        assert effect.apply(entry, rule) == plain(state)

    # Any tree over the slices, from any state that can enter them.
    blocks = [(e, a, b) for e, (a, b) in zip(effects, slices)]
    while len(blocks) > 1:
        i = rnd.randrange(len(blocks) - 1)
        (e, a, _), (f, _, b) = blocks[i : i + 2]
        blocks[i : i + 2] = [(e.then(f, rule), a, b)]
        before = run(rule, rows[:a])[0]
        assert blocks[i][0].apply(plain(before), rule) == plain(run(rule, rows[a:b], before)[0])
        assert blocks[i][0].apply(None, rule) == plain(run(rule, rows[a:b])[0])


def kinds(*names):
    return lambda df: F.col("kind").isin(list(names))


def hot_frame(spark, n, seconds=1):
    kind = F.when(F.col("id") == 0, "a").when(F.col("id") == n - 1, "b").otherwise("c")
    return spark.range(n).select(F.col("id").alias("seq"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * seconds)).alias("ts"), F.lit("k").alias("key"), kind.alias("kind"))


#: Row c matches the third step, so it is tagged, but never takes a state that waits for step two.
OPEN = SequenceSpec("open", [step(kinds("a")), step(kinds("b")), step(kinds("c"))], by="key", maxspan="4h")
CLOSED = SequenceSpec("closed", [step(kinds("a")), step(kinds("b"))], by="key", maxspan="4h", expire_when=kinds("never"))


def jobs_of(spark, build):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    build().collect()
    return len(set(tracker.getJobIdsForGroup()) - before)


def test_an_open_state_through_many_slices_takes_log_rounds(spark, monkeypatch):
    monkeypatch.setattr(sequences, "SLICES_PER_PART", 4)
    monkeypatch.setattr(sequences, "BLOCKS_PER_STEP", 4)
    few, many = (jobs_of(spark, lambda n=n: sequence_match(hot_frame(spark, n), OPEN, rows_per_slice=10)) for n in (200, 2000))
    assert many <= few + 12  # two more levels up and down, not 180 more rounds


@pytest.mark.parametrize("options", [(1, 2), (2, 3), (32, 32)])
def test_a_match_over_all_slices_is_found(spark, monkeypatch, options):
    monkeypatch.setattr(sequences, "SLICES_PER_PART", options[0])
    monkeypatch.setattr(sequences, "BLOCKS_PER_STEP", options[1])
    n = 700
    late = spark.createDataFrame([(n, START, "k", "c")], "seq bigint, ts timestamp, key string, kind string").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + n)))
    found = sequence_match(hot_frame(spark, n).unionByName(late), OPEN, keep=["kind"], rows_per_slice=10).collect()
    assert [[(e.seq, e.kind) for e in r.events] for r in found] == [[(0, "a"), (n - 1, "b"), (n, "c")]]


def test_rows_of_one_second_are_spread(spark):
    """2,000 rows within one second, and a few far away, are cut by rank, not by width."""
    rnd = random.Random(4)
    data = [(i, START + timedelta(microseconds=rnd.randrange(1_000_000)), "k", rnd.choice("ab")) for i in range(2000)]
    data += [(5000 + i, START + timedelta(days=i + 1), "k", "a") for i in range(3)]
    df = spark.createDataFrame(data, "seq bigint, ts timestamp, key string, kind string")
    spec = SequenceSpec("pair", [step(kinds("a")), step(kinds("b"))], by="key", maxspan="1s")
    whole = {tuple(e.seq for e in r.events) for r in sequence_match(df, spec).collect()}
    assert len(whole) > 100
    assert {tuple(e.seq for e in r.events) for r in sequence_match(df, spec, rows_per_slice=20).collect()} == whole
