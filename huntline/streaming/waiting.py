"""Rows that wait on a stream for the watermark: packed, sorted Arrow blocks in a map of the state store.

A call of the state store for each row, or a state key for each event, costs
many times what the work on it does. Rows are stored as blocks of up to ``ROWS``,
under the time of their first row, and read back in order of time: a block is
opened when the time before it is done, so that only blocks that overlap are in
memory, however many rows wait. Blocks that begin after the watermark are not
read. Many small keys share a ``bucket``, and with it timers and blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from ..schema import struct

# Helpers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a block, and rows that are sorted at a time.
ROWS, PASS = 1024, 32768
#: Buckets that small keys share; part of what a checkpoint was written with.
BUCKETS = 1024
#: Looked-up states that stay at hand.
NEAR = 100_000
_L = T.LongType()
KEY, BLOCK, NUMBER = struct(first=_L, number=_L), struct(rows=T.BinaryType()), struct(n=_L)


def bucket(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(block))).read_all()


class Waiting:
    """Waiting rows of a state key; ``order`` names the columns that sort them, first the time in microseconds."""

    def __init__(self, handle: StatefulProcessorHandle, schema: pa.Schema, order: list[str]):
        self.schema, self.time, self.order = schema, order[0], [(name, "ascending") for name in order]
        self.blocks = handle.getMapState("waiting", KEY, BLOCK)
        self.number = handle.getValueState("waiting_number", NUMBER)

    def put_frames(self, frames: Iterator[pd.DataFrame]) -> int:
        """Puts rows as they arrive, a frame at a time; the earliest time."""
        return min(self.put(pa.Table.from_pandas(pdf, self.schema, preserve_index=False)) for pdf in frames)

    def put(self, rows: pa.Table) -> int:
        rows = rows.take(pc.sort_indices(rows, self.order))
        n = self.number.get()[0] if self.number.exists() else 0
        times = rows.column(self.time)
        for at in range(0, len(rows), ROWS):
            self.blocks.updateValue((times[at].as_py(), n), (packed(rows.slice(at, ROWS)),))
            n += 1
        self.number.update((n,))
        return times[0].as_py()

    def due(self, mark: int) -> Iterator[pa.Table]:
        """Takes out the rows that the watermark (in milliseconds) has passed, in order; the others stay."""
        end = (mark + 1) * 1000
        keys = sorted(tuple(k) for k in self.blocks.keys())
        keys = [k for k in keys if k[0] < end]
        held, fresh, rest = [], 0, 0
        for i, key in enumerate(keys):
            rows = unpacked(self.blocks.getValue(key)[0])
            self.blocks.removeKey(key)
            n = self._before(rows, end)
            if n < len(rows):
                self.put(rows.slice(n))
            held.append(rows.slice(0, n))
            fresh += n
            last = i + 1 == len(keys)
            if not last and fresh < max(PASS, rest):
                continue
            rows = pa.concat_tables(held)
            rows = rows.take(pc.sort_indices(rows, self.order)).combine_chunks()
            n = len(rows) if last else self._before(rows, keys[i + 1][0])
            # A copy, so that what is done with doesn't stay in memory.
            held, fresh, rest = [rows.take(pa.array(range(n, len(rows)), pa.int64()))], 0, len(rows) - n
            if n:
                yield rows.slice(0, n)

    def _before(self, rows: pa.Table, time: int) -> int:
        return pc.sum(pc.less(rows.column(self.time), time)).as_py() or 0

    def first(self) -> int | None:
        """The earliest time that waits; a key without rows keeps nothing."""
        first = min((k[0] for k in self.blocks.keys()), default=None)
        if first is None:
            self.number.clear()
        return first


class Kept:
    """States by key in a map of the state store: a call looks up what it touches and writes what it has changed."""

    def __init__(self, store):
        self.store = store

    def open(self) -> None:
        self.was, self.now, self.some = {}, {}, self.store.exists()

    def get(self, key: tuple) -> Any:
        if key not in self.now:
            found = tuple(self.store.getValue(key)) if self.some and self.store.containsKey(key) else None
            self.was[key] = self.now[key] = found
        return self.now[key]

    def put(self, key: tuple, state: tuple | None) -> None:
        self.now[key] = state

    def close(self) -> None:
        for key, state in self.now.items():
            if state is not None and state != self.was.get(key):
                self.store.updateValue(key, state)
            elif state is None and self.was.get(key) is not None:
                self.store.removeKey(key)
