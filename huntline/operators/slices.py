"""What a slice of a sequence key's rows does to any state that enters it, and how slices compose.

A key with very many rows is folded slice by slice. The state that enters a
slice is not known before all earlier slices are folded; but what the slice
does with *any* state is: a state is idle or open with a set of filled steps,
and of its times only one matters, the one its lifetime counts from (`since`).
So a slice is a function, with the exit for an idle entry, and for each set of
filled steps a list of pieces over `since`. A piece's outcome is a state of the
slice's own, or the entry itself, perhaps advanced by rows of the slice.

Two such functions compose to one of the same form, and composition is
associative: a tree of blocks gives the entry of every slice in a number of
rounds that is the logarithm of the number of slices, whatever states run
through them.

Rows of equal time lie in one slice, so the rule that a row must be younger
than the last match never reaches over a slice's edge. States name their events
by (part, slice, position); the events themselves stay where they are.

A piece is needed for each row at which an entry may expire and that leads to
an exit of its own. Where sequences complete, exits coincide and few pieces
remain; at worst there is one for each row of the key within one lifetime.
"""

from __future__ import annotations

import pickle
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = -(1 << 62)
Ref = tuple[int, int, int]


class Rule(NamedTuple):
    """What of a sequence's definition the slices need."""

    steps: int
    ordered: bool
    total: bool
    span: int


class State(NamedTuple):
    """An open state; None stands for the idle one."""

    filled: int
    entered: int
    started: int
    refs: tuple[Ref, ...]


class Through(NamedTuple):
    """The entry, still open: filled steps, when last advanced (None: not in here), rows added."""

    filled: int
    entered: int | None
    refs: tuple[Ref, ...]


Outcome = State | Through | None


@dataclass
class Effect:
    """A slice, or a block of slices, as a function of the state that enters it."""

    idle: State | None
    #: filled steps -> (lower bounds of since, outcome from there on)
    open: dict[int, tuple[list[int], list[Outcome]]]

    def at(self, filled: int, since: int) -> Outcome:
        bounds, outcomes = self.open[filled]
        return outcomes[bisect_right(bounds, since) - 1]

    def apply(self, state: State | None, rule: Rule) -> State | None:
        if state is None:
            return self.idle
        out = self.at(state.filled, state.started if rule.total else state.entered)
        if isinstance(out, Through):
            return State(out.filled, state.entered if out.entered is None else out.entered, state.started, state.refs + out.refs)
        return out

    def then(self, after: Effect, rule: Rule) -> Effect:
        return Effect(after.apply(self.idle, rule), {m: _pieces(self._through(m, after, rule)) for m in self.open})

    def _through(self, m: int, after: Effect, rule: Rule) -> Iterator[tuple[int, Outcome]]:
        bounds, outcomes = self.open[m]
        for low, high, out in zip(bounds, [*bounds[1:], None], outcomes, strict=True):
            if not isinstance(out, Through):
                yield low, after.apply(out, rule)
            elif out.entered is not None and not rule.total:
                yield low, _joined(out, after.at(out.filled, out.entered))
            else:
                further, theirs = after.open[out.filled]
                at = bisect_right(further, low) - 1
                yield low, _joined(out, theirs[at])
                while at + 1 < len(further) and (high is None or further[at + 1] < high):
                    at += 1
                    yield further[at], _joined(out, theirs[at])


    def pack(self) -> bytes:
        """As plain values, which any worker reads whatever it knows of this package."""
        plain = lambda o: o and (isinstance(o, Through), *o)
        return pickle.dumps((plain(self.idle), {m: (bounds, [plain(o) for o in outcomes]) for m, (bounds, outcomes) in self.open.items()}))

    @classmethod
    def unpack(cls, packed: bytes) -> Effect:
        whole = lambda o: o and (Through if o[0] else State)(*o[1:])
        idle, opened = pickle.loads(packed)
        return cls(whole(idle), {m: (bounds, [whole(o) for o in outcomes]) for m, (bounds, outcomes) in opened.items()})


def _joined(first: Through, second: Outcome) -> Outcome:
    if isinstance(second, Through):
        return Through(second.filled, first.entered if second.entered is None else second.entered, first.refs + second.refs)
    return second


def _pieces(parts: Iterator[tuple[int, Outcome]]) -> tuple[list[int], list[Outcome]]:
    """Pieces in order of their bounds, neighbours with one outcome as one."""
    bounds, outcomes = [], []
    for low, out in parts:
        if not outcomes or outcomes[-1] != out:
            bounds.append(low)
            outcomes.append(out)
    return bounds, outcomes


def masks(rule: Rule) -> list[int]:
    """Sets of filled steps that an open state may have."""
    return [(1 << k) - 1 for k in range(1, rule.steps)] if rule.ordered else list(range(1, (1 << rule.steps) - 1))


class Slice:
    """Rows of one slice in order: times, masks of matched steps, and whether they clear the state."""

    def __init__(self, rule: Rule, place: tuple[int, int], ts: np.ndarray, mask: np.ndarray, ends: np.ndarray):
        self.rule, self.place, self.n = rule, place, len(ts)
        self.full = (1 << rule.steps) - 1
        self.ts, self.mask = ts.tolist(), mask.tolist()
        self.clearing = np.flatnonzero(ends).tolist()
        self.clears = set(self.clearing)
        self.opening = np.flatnonzero(mask & 1 if rule.ordered else mask).tolist()
        self.group_end = np.searchsorted(ts, ts, "right").tolist()
        self.advancing = {m: self._advancing(m, ts, mask) for m in masks(rule)}
        self.exits: list[State | None] = [None] * (len(self.opening) + 1)
        for i in reversed(range(len(self.opening))):
            self.exits[i] = self._opened(self.opening[i])

    def _advancing(self, m: int, ts: np.ndarray, mask: np.ndarray) -> list[int]:
        """Rows that advance a state with steps m filled, if it is open when they come."""
        if not self.rule.ordered:
            return np.flatnonzero(mask & ~m).tolist()
        # Of the rows of one time only the first that matches an open step counts; it must match the next step and no earlier one.
        hits = np.flatnonzero(mask & (2 * m + 1))
        first = hits[np.unique(ts[hits], return_index=True)[1]]
        return first[(mask[first] & m) == 0].tolist()

    def ref(self, row: int) -> Ref:
        return (*self.place, row)

    def from_idle(self, row: int) -> State | None:
        """The exit of a state that is idle before the row."""
        return self.exits[bisect_left(self.opening, row)]

    def _next(self, rows: list[int], row: int) -> int:
        at = bisect_left(rows, row)
        return rows[at] if at < len(rows) else self.n

    def _taken(self, m: int, row: int) -> int:
        return 2 * m + 1 if self.rule.ordered else m | self.mask[row]

    def _after(self, row: int) -> int:
        """First row that may advance a state which took `row`."""
        return self.group_end[row] if self.rule.ordered else row + 1

    def _opened(self, row: int) -> State | None:
        m = 1 if self.rule.ordered else self.mask[row]
        if m == self.full:
            return self.from_idle(row + 1)
        t = self.ts[row]
        out = self._walk(m, row + 1, self._after(row), t, t)
        return State(out.filled, t if out.entered is None else out.entered, t, (self.ref(row), *out.refs)) if isinstance(out, Through) else out

    def _walk(self, m: int, row: int, young: int, entered: int, started: int) -> Outcome:
        """What becomes of an open state with known times from `row` on; rows from `young` on may advance it."""
        refs: tuple[Ref, ...] = ()
        moved = None
        while True:
            since = started if self.rule.total else entered
            stop = min(self._next(self.clearing, row), self._next(self.advancing[m], young))
            dead = bisect_right(self.ts, since + self.rule.span, row)
            if dead <= stop and dead < self.n:
                return self.from_idle(dead)
            if stop == self.n:
                return Through(m, moved, refs)
            if stop in self.clears:
                return self.from_idle(stop)
            m, refs = self._taken(m, stop), (*refs, self.ref(stop))
            if m == self.full:
                return self.from_idle(stop + 1)
            entered = moved = self.ts[stop]
            row, young = stop + 1, self._after(stop)

    def _entering(self, m: int) -> Iterator[tuple[int, Outcome]]:
        """Pieces over since for an entry with steps m filled."""
        row = young = 0
        low, moved, refs = NEVER, None, ()
        while True:
            stop = min(self._next(self.clearing, row), self._next(self.advancing[m], young))
            # Entries too old for a row up to the stop are idle from that row on.
            at = row
            while at <= stop and at < self.n:
                bound = self.ts[at] - self.rule.span
                if bound > low:
                    yield low, self.from_idle(at)
                    low = bound
                at = self.group_end[at]
            if stop == self.n:
                yield low, Through(m, moved, refs)
                return
            if stop in self.clears:
                yield low, self.from_idle(stop)
                return
            m, moved, refs = self._taken(m, stop), self.ts[stop], (*refs, self.ref(stop))
            if m == self.full:
                yield low, self.from_idle(stop + 1)
                return
            row, young = stop + 1, self._after(stop)
            if not self.rule.total:
                out = self._walk(m, row, young, moved, moved)
                yield low, _joined(Through(m, moved, refs), out)
                return

    def effect(self) -> Effect:
        return Effect(self.from_idle(0), {m: _pieces(self._entering(m)) for m in masks(self.rule)})


# --- Arrow -----------------------------------------------------------------

EFFECT = "rule int, key string, part int, slice int, effect binary"
ENTRY = "rule int, key string, part int, slice int, filled int, entered long, started long, refs array<struct<part:int,slice:int,row:int>>"


def effects(batches: Iterator[pa.RecordBatch], rules: list[Rule]) -> Iterator[pa.RecordBatch]:
    """Each slice (lists ts, mask, ends) as a packed Effect."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            r, part, number = (batch.column(c)[i].as_py() for c in ("rule", "part", "slice"))
            ts, mask, ends = (np.asarray(batch.column(c)[i].values) for c in ("ts", "mask", "ends"))
            out.append(Slice(rules[r], (part, number), ts, mask.astype(np.int64), ends.astype(bool)).effect().pack())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rule", "key", "part", "slice")), pa.array(out, pa.binary())], ["rule", "key", "part", "slice", "effect"])


def composed(table: pa.Table, rules: list[Rule], block: int) -> pa.Table:
    """One Effect for the rows (part, slice, effect) of one block; it takes the block's number as its part."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["slice"]))
    rule = rules[rows[0]["rule"]]
    whole = Effect.unpack(rows[0]["effect"])
    for r in rows[1:]:
        whole = whole.then(Effect.unpack(r["effect"]), rule)
    return pa.table({"rule": pa.array([rows[0]["rule"]], pa.int32()), "key": pa.array([rows[0]["key"]], pa.string()), "part": pa.array([block], pa.int32()),
                     "slice": pa.array([0], pa.int32()), "effect": pa.array([whole.pack()], pa.binary())})


def entered(table: pa.Table, entry: pa.Table, rules: list[Rule]) -> pa.Table:
    """The entry of each row of one block, from the block's own (none: idle)."""
    state = None
    for e in entry.to_pylist():
        if e["filled"]:
            state = State(e["filled"], e["entered"], e["started"], tuple((r["part"], r["slice"], r["row"]) for r in e["refs"]))
    out = []
    for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["slice"])):
        s = state or State(0, 0, 0, ())
        out.append({"rule": r["rule"], "key": r["key"], "part": r["part"], "slice": r["slice"], "filled": s.filled, "entered": s.entered, "started": s.started,
                    "refs": [{"part": p, "slice": n, "row": i} for p, n, i in s.refs]})
        state = Effect.unpack(r["effect"]).apply(state, rules[r["rule"]])
    return pa.Table.from_pylist(out, _ENTRY_TYPE)


_REF = pa.struct([("part", pa.int32()), ("slice", pa.int32()), ("row", pa.int32())])
_ENTRY_TYPE = pa.schema([("rule", pa.int32()), ("key", pa.string()), ("part", pa.int32()), ("slice", pa.int32()), ("filled", pa.int32()), ("entered", pa.int64()), ("started", pa.int64()), ("refs", pa.list_(_REF))])


def cut(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (rule, key, item) with part and slice; a slice ends after `limit` rows, with the last row of its time."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    owner, number, held, last = None, 0, 0, None
    for batch in batches:
        rule, key, ts = batch.column("rule").to_pylist(), batch.column("key").to_pylist(), batch.column("item").field("ts").to_pylist()
        out = []
        for r, k, t in zip(rule, key, ts, strict=True):
            if (r, k) != owner:
                owner, number, held = (r, k), 0, 0
            elif held >= limit and t != last:
                number, held = number + 1, 0
            held, last = held + 1, t
            out.append(number)
        parts = pa.array(np.full(batch.num_rows, part, np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(out, pa.int32())], [*batch.schema.names, "part", "slice"])
