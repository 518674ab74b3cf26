"""Processors of streams over packed waiting rows: results of a loop, few calls of the state store, frames not kept."""

from __future__ import annotations

import random
import weakref

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from huntline.operators import bound
from huntline.operators.sequences import SequenceSpec, step
from huntline.streaming import sequence, waiting
from huntline.streaming.pairing import LEFT, RIGHT, PairProcessor, meet_newest, meet_oldest
from huntline.streaming.sequence import IDLE, AskingProcessor, SequenceProcessor, advance

END = 10**14


class Handle:
    """State of one key in memory; counts the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, name, *_):
        return State(self)

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class State:
    def __init__(self, handle):
        self.handle, self.rows, self.value = handle, {}, None

    def __getattribute__(self, name):
        if name in ("updateValue", "getValue", "removeKey", "containsKey", "update", "get"):
            self.handle.calls += 1
        return object.__getattribute__(self, name)

    def exists(self):
        return bool(self.rows) or self.value is not None

    def keys(self):
        return iter(list(self.rows))

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.rows, self.value = {}, None


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def started(processor):
    handle = Handle()
    processor.init(handle)
    return processor, handle


def feed(processor, frames, mark=0, key=(0, "k")):
    list(processor.handleInputRows(key, iter(frames), Mark(mark)))


def expired(processor, mark, key=(0, "k")):
    return [row for pdf in processor.handleExpiredTimer(key, Mark(mark), None) for row in pdf.itertuples(index=False)]


def test_rows_come_due_in_order(monkeypatch):
    monkeypatch.setattr(waiting, "ROWS", 8)
    monkeypatch.setattr(waiting, "PASS", 20)
    rnd, handle = random.Random(3), Handle()
    rows = waiting.Waiting(handle, pa.schema([("ts", pa.int64()), ("seq", pa.int64())]), ["ts", "seq"])
    left, seq = [], 0
    for mark in (300, 301, 900, 5000, 5000, 20_000):
        fresh = [(rnd.randrange(mark * 1000, 12_000_000 + mark * 1000), seq + i) for i in range(300)]
        seq += 300
        for at in range(0, 300, 50):
            part = fresh[at : at + 50]
            first = rows.put_frames([pd.DataFrame(part, columns=["ts", "seq"])])
            assert first == min(t for t, _ in part)
        left = sorted(left + fresh)
        chunks = [list(zip(*(t.column(c).to_pylist() for c in ("ts", "seq")))) for t in rows.due(mark)]
        due = [r for r in left if r[0] // 1000 <= mark]
        assert [r for c in chunks for r in c] == due
        left = left[len(due) :]
        assert rows.first() == (left[0][0] if left else None)
    assert [r for t in rows.due(100_000) for r in zip(*(t.column(c).to_pylist() for c in ("ts", "seq")))] == left
    assert rows.first() is None and not rows.blocks.exists() and not rows.number.exists()


def pairs(rows):
    return pd.DataFrame([(f"k{k}", at, side, i, s, f"p{i}", pd.Timestamp(at, unit="us", tz="UTC")) for i, (k, at, side, s) in enumerate(rows)],
                        columns=["key", "at", "side", "seq", "same", "payload", "event_time"])


def paired_by_loop(frame, meet, within):
    """Each key on its own, all rows at once."""
    out = []
    for _, own in frame.groupby("key"):
        rows = sorted((r.at, r.side, r.seq, r.same, r.payload) for r in own.itertuples())
        held, met = meet([], rows, within)
        out += met + [(w[4], None) for w in held if w[1] == LEFT]
    return sorted(out, key=str)


def test_marks_of_one_event_share_state():
    """q14's keys have two rows each; a state, a timer and calls for each of them took most of the time."""
    n = 4000
    frame = pairs([(k, 1_000_000 * k, LEFT, None) for k in range(n)] + [(k, 1_000_000 * k + 200_000 * (k % 5), RIGHT, None) for k in range(n)])
    processor, handle = started(PairProcessor(500_000, newest=False))
    feed(processor, [frame.iloc[i::4] for i in range(4)])
    out = expired(processor, END)
    assert sorted(map(tuple, out), key=str) == paired_by_loop(frame, meet_oldest, 500_000)
    assert sum(found is not None for _, found in out) == n // 5 * 3
    assert handle.calls < 100
    assert len(handle.timers) == 1


@pytest.mark.parametrize("newest", [False, True])
def test_pairs_over_many_marks(newest):
    rnd = random.Random(5)
    rows = [(rnd.randrange(8), rnd.randrange(20_000) * 1000, rnd.choice([LEFT, RIGHT]), rnd.choice(["a", "a", "b", None])) for _ in range(900)]
    frame = pairs(rows)
    processor, handle = started(PairProcessor(700_000, newest))
    out, times = [], frame["at"] // 1000
    for mark in range(500, 22_000, 500):
        fresh = frame[(times >= mark - 500) & (times < mark)]
        if len(fresh):
            feed(processor, [fresh], mark - 500)
        # Nothing is due before the timers say so.
        if any(t <= mark - 1 for t in handle.timers):
            handle.timers = {t for t in handle.timers if t > mark - 1}
            out += expired(processor, mark - 1)
    assert sorted(map(tuple, out), key=str) == paired_by_loop(frame, meet_newest if newest else meet_oldest, 700_000)
    assert not handle.timers and not processor.waiting.store.exists() and not processor.arrived.blocks.exists()


def events(n, keys, seed):
    rnd = np.random.default_rng(seed)
    return pd.DataFrame({"rule": 0, "key": [f"k{k}" for k in rnd.integers(0, keys, n)], "ts": np.sort(rnd.integers(0, 10**9, n)), "seq": np.arange(n),
                         "mask": rnd.integers(1, 3, n), "ends": False})


def test_keys_of_sequences_share_a_bucket():
    """q1's rows went into the state store one by one."""
    spec = SequenceSpec("two", [step(lambda d: d), step(lambda d: d)], by="key", maxspan="2m")
    frame = events(6000, 1500, 1)
    frame.loc[0, "key"] = None
    processor, handle = started(SequenceProcessor([spec]))
    feed(processor, [frame.iloc[i::3] for i in range(3)])
    assert handle.calls < 60
    out = expired(processor, 400_000) + expired(processor, 700_000) + expired(processor, END)
    states, want = {}, []
    for r in frame.itertuples():
        states[r.key], found = advance(states.get(r.key, IDLE), (r.ts, r.seq, r.mask, r.ends), spec)
        if found:
            want.append((r.key, tuple(found[1])))
    assert len(want) > 500
    assert sorted(((o.key, tuple(e["seq"] for e in o.events)) for o in out), key=str) == sorted(want, key=str)
    assert not processor.waiting.blocks.exists()


def test_frames_of_a_hot_key_are_not_kept(monkeypatch):
    """F2: q5's few keys had all rows of a micro-batch, and of the table, in a worker's memory."""
    monkeypatch.setattr(waiting, "PASS", 2000)
    spec = SequenceSpec("same", [step(lambda d: d, alias="a"), step(lambda d: d, same={"v": "a.v"})], by="key", maxspan="2m")
    frame = events(20_000, 1, 2)
    values = [[str(v)] for v in np.random.default_rng(4).integers(0, 300, len(frame))]
    frame["wants"], frame["haves"] = values, values
    alive, most = weakref.WeakSet(), 0

    class Frame(pd.DataFrame):
        __hash__ = object.__hash__

    def frames():
        nonlocal most
        for at in range(0, len(frame), 500):
            part = Frame(frame.iloc[at : at + 500].copy())
            alive.add(part)
            most = max(most, len(alive))
            yield part
            del part

    processor, handle = started(AskingProcessor(spec))
    feed(processor, frames())
    assert most <= 2
    sizes, due = [], processor.waiting.due
    monkeypatch.setattr(processor.waiting, "due", lambda mark: (sizes.append(len(t)) or t for t in due(mark)))
    calls = handle.calls
    out = expired(processor, END)
    assert handle.calls - calls < 1000  # a call per pending event would be some 10,000
    assert max(sizes) <= 4000 and len(sizes) > 5
    now, want = bound.Open(spec.terms), []
    for r in frame.itertuples():
        found = now.take(r.ts, r.mask, r.ends, r.wants, r.haves, (r.ts, r.seq))
        if found:
            want.append([s for _, s in sorted(found)])
    assert len(want) > 50
    # What stays open between calls, and is at hand in small numbers only, gives the same.
    monkeypatch.setattr(sequence, "NEAR", 3)
    again, _ = started(AskingProcessor(spec))
    feed(again, frames())
    parts = [o for mark in (*range(0, 1_000_000, 50_000), END) for o in expired(again, mark)]
    assert [[e["seq"] for e in o.events] for o in parts] == want
    assert [[e["seq"] for e in o.events] for o in out] == want
