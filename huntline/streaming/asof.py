"""Streaming form of the as-of join: one keyed state per key, with a time to live.

Rows of both sides wait in the key's buffer until the watermark has passed
them, then meet in event-time order, so the result is that of the batch join
whatever the order of arrival inside the watermark. The state of a key is
dropped once it is older than its time to live, and with it the key.
"""

from __future__ import annotations

import sys
from typing import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..durations import micros
from ..schema import struct
from .sequence import use_state_store

# The processor travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_ROW, EVENT_ROW, END_ROW = 0, 1, 2
_L = T.LongType()
ROW = struct(at=_L, side=T.IntegerType(), seq=_L, payload=T.StringType())
HELD = struct(at=_L, payload=T.StringType())
OUTPUT = struct(payload=T.StringType(), state=T.StringType())


class AsofProcessor(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), int(s), int(q), p) for pdf in rows for a, s, q, p in zip(pdf["at"], pdf.side, pdf.seq, pdf.payload)]
        self.waiting.appendList(fresh)
        self.handle.registerTimer(max(min(r[0] for r in fresh) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in rows if r[0] // 1000 <= mark]
        later = rows[len(due):]
        held = tuple(self.held.get()) if self.held.exists() else None
        out = []
        for at, side, _, payload in due:
            if side == STATE_ROW:
                held = (at, payload)
            elif side == END_ROW:
                held = None
            else:
                out.append((payload, held[1] if held and at - held[0] <= self.ttl else None))
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
            self.handle.registerTimer(max(later[0][0] // 1000, mark + 1))
        if held and mark * 1000 - held[0] <= self.ttl:
            self.held.update(held)
            self.handle.registerTimer(max((held[0] + self.ttl) // 1000 + 1, mark + 1))
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["payload", "state"])

    def close(self) -> None:
        pass


def asof_stream(events: DataFrame, states: DataFrame, keys: list[str], columns: list[str], ttl: str, ends: DataFrame | None = None,
                ts: str = "ts", seq: str = "seq", watermark: str = "10 minutes") -> DataFrame:
    """events with the columns of their key's latest state row, if it is at most ``ttl`` old and no end row came since.

    At equal times states come first and ends last. Events without a key, and
    columns of events without a state, are null.
    """
    use_state_store(events.sparkSession)
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()

    def side(df: DataFrame, number: int, payload: list[str]):
        body = F.to_json(F.struct(*payload)) if payload else F.lit("")
        return df.where(present).select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.lit(number).alias("side"), F.col(seq).cast("long").alias("seq"),
                                        body.alias("payload"), F.col(ts).cast("timestamp").alias("event_time"))

    rows = side(events, EVENT_ROW, events.columns).unionByName(side(states, STATE_ROW, columns))
    if ends is not None:
        rows = rows.unionByName(side(ends, END_ROW, []))
    met = rows.withWatermark("event_time", watermark).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=AsofProcessor(micros(ttl)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    own = T.StructType([events.schema[c] for c in events.columns])
    theirs = T.StructType([T.StructField(c, states.schema[c].dataType) for c in columns])
    joined = met.select(F.from_json("payload", own).alias("e"), F.from_json("state", theirs).alias("s")).select("e.*", "s.*")
    return joined.unionByName(events.where(~present), allowMissingColumns=True)
