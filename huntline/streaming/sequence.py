"""Streaming form of sequence matching: one automaton per (rule, key).

Rows wait until the watermark has passed them, so that late arrivals inside
the watermark are taken in event-time order; then they go through the same
automaton as in batch. Rows and automata live in the RocksDB state store, rows
packed as blocks; keys share buckets, and a timer per bucket wakes it when the
watermark moves. A sequence that asks for equal values has a state per key.
"""

from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import bound
from ..operators.sequences import SequenceSpec, asked_values, tag_rows
from ..schema import struct
from .waiting import NEAR, Kept, Waiting, bucket

# The processor travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_L = T.LongType()
ROW = pa.schema([("rule", pa.int32()), ("key", pa.string()), ("ts", pa.int64()), ("seq", pa.int64()), ("mask", pa.int32()), ("ends", pa.bool_())])
ASKING_ROW = pa.schema([*list(ROW)[2:], ("wants", pa.list_(pa.string())), ("haves", pa.list_(pa.string()))])
ORDER = ["ts", "seq", "mask", "ends"]
OWNER = struct(rule=T.IntegerType(), key=T.StringType())
OPEN = struct(filled=T.IntegerType(), entered=_L, started=_L, last=_L, times=T.ArrayType(_L), seqs=T.ArrayType(_L))
VALUE, EVENT = struct(ask=T.IntegerType(), value=T.StringType()), struct(ts=_L, seq=_L)
STATE = struct(filled=T.IntegerType(), entered=_L, started=_L, last=_L, times=T.ArrayType(_L), seqs=T.ArrayType(_L))
OUTPUT = struct(rule=T.StringType(), key=T.StringType(), start_ts=T.TimestampType(), end_ts=T.TimestampType(),
                events=T.ArrayType(struct(ts=T.TimestampType(), seq=_L)))
IDLE = (0, 0, 0, 0, [], [])


def use_state_store(spark: SparkSession) -> None:
    """State that may exceed memory belongs in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get(key, "") != rocks:
        spark.conf.set(key, rocks)


def advance(state: tuple, row: tuple, spec: SequenceSpec) -> tuple[tuple, tuple | None]:
    """One automaton step: new state and the finished (times, seqs), if any."""
    filled, entered, started, last, times, seqs = state
    ts, seq, mask, ends = row
    since = started if spec.span == "total" else entered
    if ends or (filled and ts - since > spec.span_us):
        filled, times, seqs = 0, [], []
    if spec.ordered:
        usable = mask & (2 * filled + 1) if not filled or ts > last else 0
        hit = usable & -usable
        new = hit if hit == filled + 1 else 0
    else:
        hit, new = mask, mask & ~filled
    if hit:
        last = ts
    if new:
        started = started if filled else ts
        entered, filled, times, seqs = ts, filled | new, [*times, ts], [*seqs, seq]
        if filled == (1 << len(spec.steps)) - 1:
            return IDLE, (times, seqs)
    return (filled, entered, started, last, times, seqs), None


def _matches(found: list[tuple]) -> pd.DataFrame:
    """Output of (rule, key, [(ts, seq), …])."""
    stamp = lambda t: pd.Timestamp(t, unit="us", tz="UTC")
    return pd.DataFrame({
        "rule": [f[0] for f in found], "key": [f[1] for f in found], "start_ts": [stamp(f[2][0][0]) for f in found],
        "end_ts": [stamp(f[2][-1][0]) for f in found], "events": [[{"ts": stamp(t), "seq": s} for t, s in f[2]] for f in found]})


class SequenceProcessor(StatefulProcessor):
    """Sequences of the keys of a bucket."""

    def __init__(self, specs: list[SequenceSpec]):
        # Only the plain numbers of a spec travel to the executors, not its predicates.
        self.specs = [_Numbers(s) for s in specs]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, ROW, ORDER)
        self.states = Kept(handle.getMapState("states", OWNER, STATE))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.waiting.put_frames(rows) // 1000
        self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.states.open()
        for rows in self.waiting.due(mark):
            out = []
            for rule, name, *row in zip(*(rows.column(c).to_pylist() for c in ROW.names), strict=True):
                spec = self.specs[rule]
                state, found = advance(self.states.get((rule, name)) or IDLE, tuple(row), spec)
                self.states.put((rule, name), state if state[0] else None)
                if found:
                    out.append((spec.name, name, list(zip(*found))))
            if out:
                yield _matches(out)
        self.states.close()
        first = self.waiting.first()
        if first is not None:
            self.handle.registerTimer(max(first // 1000, mark + 1))

    def close(self) -> None:
        pass


class Stored:
    """Pending events by value in the state store. New ones stay at hand, up to a number, until the call ends: most are closed before."""

    def __init__(self, store):
        self.store, self.near, self.fresh, self.empty = store, {}, {}, not store.exists()

    def get(self, at: tuple[int, str]):
        if self.empty or at in self.fresh:
            return self.fresh.get(at)
        if at not in self.near:
            if len(self.near) >= NEAR:
                self.near = {}
            self.near[at] = tuple(self.store.getValue(at)) if self.store.containsKey(at) else None
        return self.near[at]

    def __setitem__(self, at: tuple[int, str], event: tuple[int, int]) -> None:
        self.fresh[at] = event
        if len(self.fresh) >= NEAR:
            self.write()

    def write(self) -> None:
        for at, event in self.fresh.items():
            self.store.updateValue(at, event)
        self.empty, self.near, self.fresh = self.empty and not self.fresh, {}, {}

    def clear(self) -> None:
        self.near, self.fresh = {}, {}
        if not self.empty:
            self.store.clear()
            self.empty = True


class AskingProcessor(StatefulProcessor):
    """A sequence whose steps ask for equal values. Rows wait in blocks, pending events in a map by value; one timer waits for the first row."""

    def __init__(self, spec: SequenceSpec):
        self.name, self.terms = spec.name, spec.terms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, ASKING_ROW, ORDER)
        self.state = handle.getValueState("state", OPEN)
        self.held = handle.getMapState("held", VALUE, EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.waiting.put_frames(rows) // 1000
        self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        filled, entered, started, last, times, seqs = self.state.get() if self.state.exists() else (0, 0, 0, 0, [], [])
        held = Stored(self.held)
        now = bound.Open(self.terms, held, filled, entered, started, last, tuple(zip(times, seqs)))
        for rows in self.waiting.due(mark):
            out = []
            for ts, seq, mask, ends, wants, haves in zip(*(rows.column(c).to_pylist() for c in ASKING_ROW.names), strict=True):
                found = now.take(ts, mask, ends, wants, haves, (ts, seq))
                if found:
                    out.append((self.name, key[1], sorted(found)))
            if out:
                yield _matches(out)
        held.write()
        if now.filled:
            self.state.update((now.filled, now.entered, now.started, now.last, [t for t, _ in now.first], [s for _, s in now.first]))
        elif self.state.exists():
            self.state.clear()
        first = self.waiting.first()
        if first is not None:
            self.handle.registerTimer(max(first // 1000, mark + 1))

    def close(self) -> None:
        pass


class _Numbers:
    def __init__(self, spec: SequenceSpec):
        self.name, self.span, self.span_us, self.ordered, self.steps = spec.name, spec.span, spec.span_us, spec.ordered, [None] * len(spec.steps)


def sequence_stream(df: DataFrame, spec: SequenceSpec | list[SequenceSpec], watermark: str = "10 minutes", ts: str = "ts",
                    seq: str = "seq") -> DataFrame:
    """Streaming matches with the columns of the batch operator; events carry ts and seq.

    A sequence whose steps ask for equal values stands alone. Other conditions on earlier events need the batch
    operator, whose fold evaluates column predicates over pending events.
    """
    specs = spec if isinstance(spec, list) else [spec]
    use_state_store(df.sparkSession)
    if len(specs) == 1 and specs[0].by_value:
        return _asking_stream(df, specs[0], watermark, ts, seq)
    if any(s.is_bound for s in specs):
        raise ValueError("sequences with bound fields run in batch or inside foreachBatch; one that asks for equal values runs alone")
    tagged = tag_rows(df, specs, ts, seq, []).select(
        bucket(F.col("rule"), F.col("key")), "rule", "key", "item.*", F.timestamp_micros(F.col("item.ts")).alias("event_time")).withWatermark("event_time", watermark)
    return tagged.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=SequenceProcessor(specs), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def _asking_stream(df: DataFrame, spec: SequenceSpec, watermark: str, ts: str, seq: str) -> DataFrame:
    fields = sorted({name for s in spec.steps for pair in s.same for name in pair})
    rows = tag_rows(df, [spec], ts, seq, fields)
    wants, haves = asked_values(spec, F.col("item"), {f.name: f.dataType for f in rows.schema["item"].dataType})
    tagged = rows.select("rule", "key", *[F.col("item")[c].alias(c) for c in ("ts", "seq", "mask", "ends")], wants.alias("wants"), haves.alias("haves"),
                         F.timestamp_micros(F.col("item.ts")).alias("event_time")).withWatermark("event_time", watermark)
    return tagged.groupBy("rule", "key").transformWithStateInPandas(
        statefulProcessor=AskingProcessor(spec), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
