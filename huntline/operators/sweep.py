"""Running sets and pairings over sorted rows, for tasks that sweep keys in order of time."""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def running_sets(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """(_row, members) of each event row (_tag 1): what its group's change rows (_member, _open) have left open before it."""
    owner, opened = None, {}
    for batch in batches:
        owners = list(zip(*(batch.column(c).to_pylist() for c in group), strict=True))
        members, kind = batch.column("_member").to_pylist(), batch.column("_member").type
        at, sets = [], []
        for i, (who, tag, opens) in enumerate(zip(owners, batch.column("_tag").to_pylist(), batch.column("_open").to_pylist(), strict=True)):
            if who != owner:
                owner, opened = who, {}
            if tag == 1:
                at.append(i)
                sets.append(list(opened.values()))
            elif opens:
                opened[tuple(members[i].values())] = members[i]
            else:
                opened.pop(tuple(members[i].values()), None)
        rows = batch.column("_row").take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows, pa.array(sets, pa.list_(kind))], ["_row", "members"])


def pairs_in_order(batches: Iterator[pa.RecordBatch], group: list[str], within: int) -> Iterator[pa.RecordBatch]:
    """(_event, callstack): each event row (_event) with the stack of the oldest unused walk row (_stack) of its group within the bound, in either order.

    Only rows within the bound wait, whatever the group holds; they go along to
    the next batch.
    """
    owner, carry = None, None
    for batch in batches:
        first = carry.num_rows if carry is not None else 0
        t = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0] if first and batch.num_rows else (carry if first and not batch.num_rows else batch)
        if t is carry:
            continue
        owners = list(zip(*(t.column(c).to_pylist() for c in group), strict=True))
        times, is_event = t.column("_t").to_pylist(), t.column("_event").is_valid().to_pylist()
        waiting, events, walks = deque(range(first)), [], []

        def alone(i: int) -> None:
            if is_event[i]:
                events.append(i)
                walks.append(None)

        for i in range(first, t.num_rows):
            if owners[i] != owner:
                owner = owners[i]
                while waiting:
                    alone(waiting.popleft())
            while waiting and times[i] - times[waiting[0]] > within:
                alone(waiting.popleft())
            if waiting and is_event[waiting[0]] != is_event[i]:
                other = waiting.popleft()
                events.append(i if is_event[i] else other)
                walks.append(other if is_event[i] else i)
            else:
                waiting.append(i)
        yield _paired(t, events, walks)
        carry = t.take(pa.array(list(waiting), pa.int64()))
    if carry is not None and carry.num_rows:
        left = [i for i, valid in enumerate(carry.column("_event").is_valid().to_pylist()) if valid]
        yield _paired(carry, left, [None] * len(left))


def _paired(t: pa.RecordBatch, events: list[int], walks: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([t.column("_event").take(pa.array(events, pa.int64())), t.column("_stack").take(pa.array(walks, pa.int64()))], ["_event", "callstack"])
