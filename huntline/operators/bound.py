"""Sequences whose steps ask for the value of an earlier step's event: the fold of one key with pending events by value.

An event that waits is held under the value that a later step will ask for, the
first one of each value only: it is the one that a match reports, so repeats add
nothing to the state, and a row costs one look into a map however many events
wait. Only the open state is held, rows stream by in order of time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Terms(NamedTuple):
    """What of a sequence's definition the fold needs; ``asks`` are (step, earlier step whose value it asks for)."""

    steps: int
    total: bool
    span: int
    asks: tuple[tuple[int, int], ...]


class Open:
    """State of one key. ``held`` maps (position in ``asks``, value) to the first event that has it; a dict, or a map in a state store."""

    def __init__(self, terms: Terms, held=None, filled: int = 0, entered: int = 0, started: int = 0, last: int = 0, first: tuple = ()):
        self.terms, self.held = terms, {} if held is None else held
        self.filled, self.entered, self.started, self.last, self.first = filled, entered, started, last, list(first)

    def close(self) -> None:
        if self.filled:
            self.filled, self.first = 0, []
            self.held.clear()

    def take(self, ts: int, mask: int, ends: bool, wants: list[str | None], haves: list[str | None], event: Any) -> list | None:
        """Advance by one row; the events of a sequence that it completes, one for each step."""
        t = self.terms
        if ends or (self.filled and ts - (self.started if t.total else self.entered) > t.span):
            self.close()
        answer = None
        for n, (i, _) in enumerate(t.asks):
            if mask >> i & 1:
                found = self.held.get((n, wants[n])) if self.filled + 1 >= 1 << i and wants[n] is not None else None
                if found is None:
                    mask &= ~(1 << i)
                elif i == t.steps - 1:
                    answer = (t.asks[n][1], found)
        usable = mask & (2 * self.filled + 1) if not self.filled or ts > self.last else 0
        hit = usable & -usable
        if not hit:
            return None
        at = hit.bit_length() - 1
        if hit == self.filled + 1:
            if self.filled + hit == (1 << t.steps) - 1:
                events = [*self.first, event]
                if answer:
                    events[answer[0]] = answer[1]
                self.close()
                return events
            self.started = self.started if self.filled else ts
            self.entered, self.filled = ts, self.filled | hit
            self.first.append(event)
        self.last = ts
        for n, (_, j) in enumerate(t.asks):
            if j == at and haves[n] is not None and self.held.get((n, haves[n])) is None:
                self.held[(n, haves[n])] = event
        return None


def matches(batches: Iterator[pa.RecordBatch], terms: Terms) -> Iterator[pa.RecordBatch]:
    """(rule, key, m) of every match in rows sorted by (rule, key, part, item); a part begins with nothing open.

    Events that wait keep a row each of their batch, copied out of it once.
    """
    owner, state = None, Open(terms)
    for batch in batches:
        items = batch.column("item")
        owners = list(zip(*(batch.column(c).to_pylist() for c in ("rule", "key", "part")), strict=True))
        ts, mask, ends = (pc.struct_field(items, c).to_pylist() for c in ("ts", "mask", "ends"))
        wants, haves = batch.column("wants").to_pylist(), batch.column("haves").to_pylist()
        fresh: list[list] = []
        done_by, done = [], []
        for i, who in enumerate(owners):
            if who != owner:
                owner = who
                state.close()
            was = state.filled
            event = [items, i]
            found = state.take(ts[i], mask[i], ends[i], wants[i], haves[i], event)
            if found:
                done_by.append(i)
                done += found
            elif state.filled and mask[i]:
                fresh.append(event)
            if not state.filled and was:
                fresh = []
        # Rows that nothing refers to any more cost no memory beyond this batch.
        waiting = {id(e): e for e in [*state.first, *_held_in(state.held, fresh)] if e[0] is items}
        if done_by:
            rows = pa.array(done_by, pa.int32())
            events = pa.concat_arrays([chunk.slice(at, 1) for chunk, at in done])
            offsets = pa.array(range(0, len(done) + 1, terms.steps), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("rule").take(rows), batch.column("key").take(rows), pa.ListArray.from_arrays(offsets, events)], ["rule", "key", "m"])
        if waiting:
            copied = items.take(pa.array([e[1] for e in waiting.values()], pa.int32()))
            for n, e in enumerate(waiting.values()):
                e[0], e[1] = copied, n


def _held_in(held: dict, fresh: list[list]) -> list[list]:
    """Events of this batch that are held: looked for from the end of the map, where they were put last."""
    ours, out = {id(e) for e in fresh}, []
    for e in reversed(held.values()):
        if id(e) not in ours:
            break
        out.append(e)
    return out
