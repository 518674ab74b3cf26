"""One-to-one pairing on a stream: keyed state with consumption, released by timers.

Rows of both sides wait, packed as blocks, until the watermark has passed
them, then meet in event-time order, so results are those of the batch pairing
whatever the order of arrival inside the watermark. A row is used once. State
holds what came within the watermark's delay and the pairing's bound: a timer
releases the rest, and a key without rows keeps nothing. Keys share buckets, so
a mark that only one event has costs no state and no timer of its own; what of
a key waits for a partner is looked up only when one of its rows is due, or the
row that wakes it when the bound is over. Rows later than the
watermark are dropped by Spark and counted in the query's progress
(``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..durations import micros
from ..schema import struct
from .sequence import use_state_store
from .waiting import Kept, Waiting, bucket

# The processor travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RIGHT, LEFT, WAKE = 0, 1, 2
_L = T.LongType()
ROW = pa.schema([("key", pa.string()), ("at", pa.int64()), ("side", pa.int32()), ("seq", pa.int64()), ("same", pa.string()), ("payload", pa.string())])
ORDER = ["at", "side", "seq", "payload"]
KEY = struct(key=T.StringType())
HELD = struct(rows=T.ArrayType(struct(at=_L, side=T.IntegerType(), seq=_L, same=T.StringType(), payload=T.StringType())))
OUTPUT = struct(payload=T.StringType(), found=T.StringType())


def meet_oldest(waiting: list[tuple], due: list[tuple], within: int) -> tuple[list[tuple], list[tuple]]:
    """(still waiting, (left payload, right payload or None)): a row takes the oldest waiting row of the other side within the bound."""
    out = []
    for row in due:
        out += [(w[4], None) for w in waiting if row[0] - w[0] > within and w[1] == LEFT]
        waiting = [w for w in waiting if row[0] - w[0] <= within]
        if waiting and waiting[0][1] != row[1]:
            left, right = (row, waiting[0]) if row[1] == LEFT else (waiting[0], row)
            out.append((left[4], right[4]))
            waiting = waiting[1:]
        else:
            waiting = [*waiting, row]
    return waiting, out


def meet_newest(waiting: list[tuple], due: list[tuple], within: int) -> tuple[list[tuple], list[tuple]]:
    """The same for left rows that take the newest right row before them, if it is fresh, agrees in ``same`` and is unused."""
    out = []
    for row in due:
        if row[1] == RIGHT:
            waiting = [row]
            continue
        fits = waiting and row[0] - waiting[0][0] <= within and row[3] is not None and row[3] == waiting[0][3]
        out.append((row[4], waiting[0][4] if fits else None))
        if fits:
            waiting = []
    return waiting, out


class PairProcessor(StatefulProcessor):
    def __init__(self, within: int, newest: bool):
        self.within, self.newest = within, newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = Waiting(handle, ROW, ORDER)
        self.waiting = Kept(handle.getMapState("held", KEY, HELD))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.arrived.put_frames(rows) // 1000
        self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        meet = meet_newest if self.newest else meet_oldest
        self.waiting.open()
        woken = set()
        for rows in self.arrived.due(mark):
            by_key: dict[str, list[tuple]] = {}
            for name, *row in zip(*(rows.column(c).to_pylist() for c in ROW.names), strict=True):
                due = by_key.setdefault(name, [])
                if row[1] == WAKE:
                    woken.add(name)
                else:
                    due.append(tuple(row))
            out = []
            for name, due in by_key.items():
                waiting, met = meet(self._waiting(name), due, self.within)
                self._keep(name, waiting)
                out += met
            if out:
                yield pd.DataFrame(out, columns=["payload", "found"])
        # Rows to come are later than the mark.
        out, wakes = [], []
        for (name,), had in list(self.waiting.was.items()):
            before = self._waiting(name)
            waiting = [w for w in before if mark * 1000 - w[0] <= self.within]
            out += [(w[4], None) for w in before if w[1] == LEFT and mark * 1000 - w[0] > self.within]
            self._keep(name, waiting)
            if waiting and (name in woken or not had or had[0][0][0] != waiting[0][0]):
                wakes.append((name, ((waiting[0][0] + self.within) // 1000 + 1) * 1000, WAKE, 0, None, ""))
        self.waiting.close()
        if wakes:
            self.arrived.put(pa.table([pa.array(c, f.type) for c, f in zip(zip(*wakes), ROW, strict=True)], schema=ROW))
        first = self.arrived.first()
        if first is not None:
            self.handle.registerTimer(max(first // 1000, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["payload", "found"])

    def _waiting(self, name: str) -> list[tuple]:
        held = self.waiting.get((name,))
        return [tuple(w) for w in held[0]] if held else []

    def _keep(self, name: str, waiting: list[tuple]) -> None:
        self.waiting.put((name,), (waiting,) if waiting else None)

    def close(self) -> None:
        pass


def pair_stream(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], within: str, newest: bool, same: str | None = None,
                ts: str = "ts", seq: str = "seq", watermark: str = "10 seconds") -> DataFrame:
    """left with ``columns`` of the right row it is paired with; left rows without a key pair with nothing."""
    use_state_store(left.sparkSession)
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()

    def side(df: DataFrame, number: int, payload: list[str]) -> DataFrame:
        order = F.col(seq).cast("long") if seq in df.columns else F.lit(0).cast("long")
        return df.where(present).select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.lit(number).alias("side"), order.alias("seq"),
                                        (F.col(same).cast("string") if same else F.lit(None).cast("string")).alias("same"),
                                        F.to_json(F.struct(*payload)).alias("payload"), F.col(ts).cast("timestamp").alias("event_time"))

    rows = side(left, LEFT, left.columns).unionByName(side(right, RIGHT, columns))
    # Zero has two signs in floating point.
    plain = [F.col(k) + F.lit(0.0) if isinstance(rows.schema[k].dataType, (T.DoubleType, T.FloatType)) else F.col(k) for k in keys]
    rows = rows.select(bucket(*plain), F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(plain)])).alias("key"), "at", "side", "seq", "same", "payload", "event_time")
    met = rows.withWatermark("event_time", watermark).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=PairProcessor(micros(within), newest), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    own = T.StructType([left.schema[c] for c in left.columns])
    theirs = T.StructType([T.StructField(c, right.schema[c].dataType) for c in columns])
    joined = met.select(F.from_json("payload", own).alias("e"), F.from_json("found", theirs).alias("s")).select("e.*", "s.*")
    return joined.unionByName(left.where(~present), allowMissingColumns=True)
