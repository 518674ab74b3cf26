"""Ordered and unordered multi-event sequences per correlation key.

Semantics: one state per (rule, key); rows are taken in (time, seq) order. A
row advances the state when it matches the next open step and is younger than
the last matched row; a row that matches an already filled step is kept as a
further candidate of that step. A state older than ``maxspan`` is cleared, a
finished sequence is reported and its rows are spent.

Execution: rows that match no step are dropped at the scan; the rest is
grouped by (rule, key) and folded by a JVM-side aggregate over the time-sorted
rows. A key with more rows than one task should hold is cut into slices of
bounded size, ranges of its rows in order. Each slice is first summed up as a
function of the state that enters it; a tree of compositions gives every slice
its true entry (see ``slices``), and then each is folded once. Rounds grow with
the logarithm of the number of slices, whatever states run through them.
Steps that ask for equal values (``same``) hold pending events by value (see
``bound``): rows stream by in order, in parts cut wherever a key pauses for
longer than the lifetime. Other conditions on earlier events keep lists in the
state, which have no such sum: their slices are folded from a guessed (idle)
state, and those whose entry turns out different are folded again until nothing
changes. Either way the result is the same as folding the key in one go.
"""

from __future__ import annotations

from dataclasses import dataclass, field as dc_field
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durations import micros
from ..functions.logic import and_, keep_where, true_or_false
from ..session import durable
from . import bound, slices

MAX_SPAN = micros("4h")
MAX_STEPS = 5
# A fold copies its finished matches with every row, so long arrays cost more than their length: slices stay short,
# and a key is cut once it has several slices' worth of rows.
ROWS_PER_SLICE = 2_000
SLICES_BEFORE_CUT = 5
BINS_PER_SLICE = 16
# Slices that one task cuts, and blocks that one step of the tree takes together.
SLICES_PER_PART = 64
BLOCKS_PER_STEP = 64
BROADCAST_ROWS = 100_000

Predicate = Callable[[DataFrame], Column]
Bound = Callable[[Column, dict[str, Column]], Column]


@dataclass(frozen=True)
class Step:
    """One step: ``pred`` over the event, optionally ``bound`` over (event, earlier aliased events).

    ``same`` pairs fields of the event with fields of one earlier aliased event that must be equal.
    """

    pred: Predicate
    by: tuple[str, ...] | None = None
    alias: str | None = None
    bound: Bound | None = None
    uses: tuple[str, ...] = ()
    same: tuple[tuple[str, str], ...] = ()


def step(pred: Predicate, by=None, alias: str | None = None, bound: Bound | None = None, uses=(), same: dict[str, str] | None = None) -> Step:
    """A step; ``same={"path": "e1.path"}`` asks for an event of step ``e1`` with an equal path (missing values equal nothing)."""
    if not same:
        return Step(pred, _names(by), alias, bound, tuple(uses))
    if bound is not None or uses:
        raise ValueError("a step asks for equal values or has a condition of its own, not both")
    aliases = {there.split(".", 1)[0] for there in same.values()}
    if len(aliases) != 1:
        raise ValueError("equal values are asked of one earlier step")
    earlier = aliases.pop()
    pairs = tuple((here, there.split(".", 1)[1]) for here, there in same.items())
    return Step(pred, _names(by), alias, lambda cur, b: and_(*[cur[h] == b[earlier][t] for h, t in pairs]), (earlier,), pairs)


def _names(by) -> tuple[str, ...] | None:
    return None if by is None else (by,) if isinstance(by, str) else tuple(by)


@dataclass(frozen=True)
class SequenceSpec:
    name: str
    steps: list[Step]
    by: str | tuple[str, ...] | None = None
    maxspan: str | int | None = None
    ordered: bool = True
    span: str = "step"
    expire_when: Predicate | None = None
    expire_by: str | None = None
    long_span: bool = False
    span_us: int = dc_field(init=False, default=0)

    def __post_init__(self):
        if len(self.steps) < 2:
            raise ValueError(f"{self.name}: a sequence needs at least two steps")
        if len(self.steps) > MAX_STEPS:
            raise ValueError(f"{self.name}: at most {MAX_STEPS} steps are allowed")
        span = MAX_SPAN if self.maxspan is None else micros(self.maxspan)
        if span > MAX_SPAN and not self.long_span:
            raise ValueError(f"{self.name}: maxspan is above the 4h limit")
        object.__setattr__(self, "span_us", span)
        per_step = [s.by is not None for s in self.steps]
        if any(per_step) and not all(per_step):
            raise ValueError(f"{self.name}: either all steps have a key or none")
        if any(per_step) and self.by is not None:
            raise ValueError(f"{self.name}: a sequence key and step keys exclude each other")
        if self.span not in ("step", "total"):
            raise ValueError(f"{self.name}: span is 'step' or 'total'")
        seen: set[str] = set()
        for s in self.steps:
            for alias in s.uses:
                if alias not in seen:
                    raise ValueError(f"{self.name}: reference to an unknown alias {alias!r}")
            if s.bound is not None and not s.uses:
                raise ValueError(f"{self.name}: a bound step names the aliases it uses")
            if s.alias:
                seen.add(s.alias)

    @property
    def is_bound(self) -> bool:
        return any(s.bound is not None for s in self.steps)

    @property
    def by_value(self) -> bool:
        """Whether all conditions on earlier events are equalities, which the fold by value takes."""
        return self.is_bound and self.ordered and all(s.same for s in self.steps if s.bound is not None)

    @property
    def terms(self) -> bound.Terms:
        order = {s.alias: i for i, s in enumerate(self.steps) if s.alias}
        asks = tuple((i, order[s.uses[0]]) for i, s in enumerate(self.steps) if s.same)
        return bound.Terms(len(self.steps), self.span == "total", self.span_us, asks)


def sequence_problems(specs: DataFrame) -> DataFrame:
    """``problem``: why a row is no valid sequence, NULL if it is one; the checks of SequenceSpec for definitions in a table.

    ``steps``: number of steps, ``keyed_steps``: how many have a key of their
    own, ``has_key``: whether the sequence has one, ``span_us``: maxspan or NULL,
    ``used``/``known``: aliases that bound steps refer to, and those of earlier steps.
    """
    unknown = F.size(F.array_except("used", "known")) > 0
    problem = (F.when(F.col("steps") < 2, "a sequence needs at least two steps")
               .when(F.col("steps") > MAX_STEPS, f"at most {MAX_STEPS} steps are allowed")
               .when(F.coalesce(F.col("span_us"), F.lit(MAX_SPAN)) > MAX_SPAN, "maxspan is above the 4h limit")
               .when((F.col("keyed_steps") > 0) & (F.col("keyed_steps") < F.col("steps")), "either all steps have a key or none")
               .when((F.col("keyed_steps") > 0) & F.col("has_key"), "a sequence key and step keys exclude each other")
               .when(F.coalesce(unknown, F.lit(False)), "reference to an unknown alias"))
    return specs.withColumn("problem", problem)


# --- tagging ---------------------------------------------------------------------------------------


def key_column(df: DataFrame, names: tuple[str, ...] | None) -> Column:
    """Correlation key as text: one field without case, several exactly; none gives one shared key."""
    if not names:
        return F.lit("")
    types = dict(df.dtypes)
    if len(names) == 1:
        text = F.col(names[0]).cast("string") if names[0] in types else F.expr(names[0]).cast("string")
        return F.coalesce(F.lower(text), F.lit(""))
    return F.to_json(F.array(*[F.coalesce(F.expr(n).cast("string"), F.lit("")) for n in names]))


def tag_rows(df: DataFrame, specs: list[SequenceSpec], ts: str, seq: str, keep: list[str]) -> DataFrame:
    """rule, key and matched-step mask per row; a row that no step or expiry wants is gone.

    All specs share this one pass over the events.
    """
    candidates, wanted = [], []
    for index, spec in enumerate(specs):
        tests = [s.pred(df) for s in spec.steps]
        wanted += tests + ([spec.expire_when(df)] if spec.expire_when else [])
        bits = [true_or_false(t) for t in tests]
        expires = true_or_false(spec.expire_when(df)) if spec.expire_when else F.lit(False)
        masks = [F.when(b, F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(bits)]
        if spec.steps[0].by is None:
            by = _names(spec.by)
            mask = masks[0]
            for m in masks[1:]:
                mask = mask + m
            same_key = spec.expire_by is None
            candidates.append(_candidate(index, key_column(df, by), mask, expires if same_key else F.lit(False)))
            if spec.expire_when and not same_key:
                candidates.append(_candidate(index, key_column(df, (spec.expire_by,)), F.lit(0), expires))
        else:
            candidates += [_candidate(index, key_column(df, s.by), m, F.lit(False)) for s, m in zip(spec.steps, masks)]
            if spec.expire_when:
                candidates.append(_candidate(index, key_column(df, _names(spec.expire_by or spec.steps[0].by)), F.lit(0), expires))
    time = F.unix_micros(F.col(ts).cast("timestamp"))
    kept = [c for c in keep if c not in ("ts", "seq")]
    rows = df.where(keep_where(*wanted)).select(
        time.alias("ts"), F.col(seq).cast("bigint").alias("seq"), *[_sortable(df, c) for c in kept],
        F.stack(F.lit(len(candidates)), *[part for c in candidates for part in c]).alias("_rule", "_key", "_mask", "_ends"))
    return rows.where("_mask != 0 or _ends").select(
        F.col("_rule").alias("rule"), F.col("_key").alias("key"),
        F.struct("ts", "seq", F.col("_mask").alias("mask"), F.col("_ends").alias("ends"), *kept).alias("item"))


def _candidate(index: int, key: Column, mask: Column, ends: Column) -> tuple[Column, ...]:
    return F.lit(index), key, mask.cast("int"), ends


def _sortable(df: DataFrame, name: str) -> Column:
    """Maps cannot be part of a sort; they travel as entries."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return F.sort_array(F.map_entries(name)).alias(name)
    return F.col(name)


# --- the fold --------------------------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """Bind a value so that it is computed once inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bound_test(st: Step, x: Column, used: list[tuple[str, int]]):
    return lambda row: true_or_false(st.bound(x, {alias: row[alias] for alias, _ in used}))


class Fold:
    """Column expressions of the automaton over one key's sorted rows."""

    def __init__(self, specs: list[SequenceSpec], item_type: T.StructType):
        self.specs = specs
        self.item_type = item_type
        self.bound = specs[0] if specs[0].is_bound else None
        if self.bound and len(specs) > 1:
            raise ValueError("sequences with bound fields are folded one at a time")

    def option(self, rule: Column, values: list) -> Column:
        if len(set(values)) == 1:
            return F.lit(values[0])
        return F.get(F.array(*[F.lit(v) for v in values]), rule)

    def idle(self) -> Column:
        item = self.item_type.simpleString()
        pending = f", cast(array() as array<array<{item}>>) as pending" if self.bound else ""
        return F.expr(f"struct(0 as filled, cast(0 as bigint) as entered, cast(0 as bigint) as started, "
                      f"cast(0 as bigint) as last, cast(array() as array<{item}>) as slots{pending})")

    def expired(self, state: Column, now: Column, rule: Column) -> Column:
        total = self.option(rule, [s.span == "total" for s in self.specs])
        span = self.option(rule, [s.span_us for s in self.specs])
        since = F.when(total, state["started"]).otherwise(state["entered"])
        return (state["filled"] != 0) & (now - since > span)

    def run(self, items: Column, entry: Column, rule: Column) -> Column:
        """struct(state, matches) after all rows, starting from ``entry``.

        A row's outcome (state and, when a sequence is done, its events) is
        bound once; the list of matches takes in the previous row's outcome, so
        it is never copied along with the bound values.
        """
        full = self.option(rule, [(1 << len(s.steps)) - 1 for s in self.specs])
        ordered = self.option(rule, [s.ordered for s in self.specs])
        none = F.expr(f"cast(array() as array<array<{self.item_type.simpleString()}>>)")
        nothing = F.expr(f"cast(array() as array<{self.item_type.simpleString()}>)")

        def outcome(state: Column, x: Column) -> Column:
            dead = self.expired(state, x["ts"], rule) | x["ends"]
            return _let(F.when(dead, self.idle()).otherwise(state), lambda s: _let(
                self._take(s, x, ordered), lambda take: self._after(s, x, take, full, nothing)))

        def matches(acc: Column) -> Column:
            return F.when(acc["now"]["done"], F.array_append(acc["matches"], acc["now"]["events"])).otherwise(acc["matches"])

        begin = F.struct(entry.alias("state"), F.lit(False).alias("done"), nothing.alias("events"))
        return F.aggregate(
            items, F.struct(begin.alias("now"), none.alias("matches")),
            lambda acc, x: F.struct(outcome(acc["now"]["state"], x).alias("now"), matches(acc).alias("matches")),
            lambda acc: F.struct(acc["now"]["state"].alias("state"), matches(acc).alias("matches")))

    def _take(self, s: Column, x: Column, ordered: Column) -> Column:
        """New bits, whether the row is a further candidate, and the slot it goes to."""
        nxt = s["filled"] + 1
        mask = self._satisfied(s, x) if self.bound else x["mask"]
        open_bits = mask.bitwiseAND(s["filled"] * 2 + 1)
        young = (s["filled"] == 0) | (x["ts"] > s["last"])
        lowest = open_bits.bitwiseAND(-open_bits)
        in_order = F.when(young & (open_bits != 0), lowest).otherwise(F.lit(0))
        fresh = mask.bitwiseAND(F.bitwise_not(s["filled"]))
        hit = F.when(ordered, in_order).otherwise(mask)
        new = F.when(ordered, F.when(in_order == nxt, nxt).otherwise(F.lit(0))).otherwise(fresh)
        return F.struct(hit.alias("hit"), new.alias("new"))

    def _satisfied(self, s: Column, x: Column) -> Column:
        """Mask of the row with bound steps kept only where some pending event fits."""
        mask = x["mask"]
        order = {st.alias: i for i, st in enumerate(self.bound.steps) if st.alias}
        for i, st in enumerate(self.bound.steps):
            if st.bound is None:
                continue
            used = [(a, order[a]) for a in st.uses]
            rows = self._aligned(s, used)
            fits = F.exists(rows, _bound_test(st, x, used))
            ready = s["filled"] + 1 >= (1 << i)
            keep = F.when((mask.bitwiseAND(1 << i) != 0) & ready & fits, F.lit(1 << i)).otherwise(F.lit(0))
            mask = mask.bitwiseAND(~(1 << i)) + keep
        return mask

    def _aligned(self, s: Column, used: list[tuple[str, int]]) -> Column:
        """Pending events of several aliases side by side; a shorter list repeats its last event."""
        def slot(i: int) -> Column:
            return F.coalesce(F.get(s["pending"], F.lit(i)), F.expr(f"cast(array() as array<{self.item_type.simpleString()}>)"))
        if len(used) == 1:
            alias, i = used[0]
            return F.transform(slot(i), lambda e: F.struct(e.alias(alias)))
        longest = F.greatest(*[F.size(slot(i)) for _, i in used])
        spots = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(spots, lambda n: F.struct(
            *[F.get(slot(i), F.least(n, F.size(slot(i)) - 1)).alias(a) for a, i in used]))

    def _after(self, s: Column, x: Column, take: Column, full: Column, nothing: Column) -> Column:
        filled = s["filled"].bitwiseOR(take["new"])
        slots = F.when(take["new"] != 0, F.array_append(s["slots"], x)).otherwise(s["slots"])
        done = filled == full
        parts = [
            filled.alias("filled"),
            F.when(take["new"] != 0, x["ts"]).otherwise(s["entered"]).alias("entered"),
            F.when((s["filled"] == 0) & (take["new"] != 0), x["ts"]).otherwise(s["started"]).alias("started"),
            F.when(take["hit"] != 0, x["ts"]).otherwise(s["last"]).alias("last"),
            slots.alias("slots"),
        ]
        report = slots
        if self.bound:
            parts.append(self._pend(s, x, take).alias("pending"))
            report = self._representatives(s, x)
        state = F.when(done, self.idle()).otherwise(F.struct(*parts))
        return F.struct(state.alias("state"), done.alias("done"), F.when(done, report).otherwise(nothing).alias("events"))

    def _pend(self, s: Column, x: Column, take: Column) -> Column:
        n = len(self.bound.steps)
        nothing = F.expr(f"cast(array() as array<{self.item_type.simpleString()}>)")
        lists = []
        for i in range(n):
            old = F.coalesce(F.get(s["pending"], F.lit(i)), nothing)
            lists.append(F.when(take["hit"].bitwiseAND(1 << i) != 0, F.array_append(old, x)).otherwise(old))
        return F.array(*lists)

    def _representatives(self, s: Column, x: Column) -> Column:
        """First pending event per step; where the last step is bound, the first one that fits it."""
        order = {st.alias: i for i, st in enumerate(self.bound.steps) if st.alias}
        last = self.bound.steps[-1]
        used = [(a, order[a]) for a in last.uses]
        chosen = {}
        if last.bound is not None:
            row = F.get(F.filter(self._aligned(s, used), _bound_test(last, x, used)), F.lit(0))
            chosen = {order[a]: row[a] for a, _ in used}
        picks = [chosen.get(i, F.get(F.get(s["pending"], F.lit(i)), F.lit(0))) for i in range(len(self.bound.steps) - 1)]
        return F.array(*picks, x)


# --- batch operator --------------------------------------------------------------------------------


def sequence_match(df: DataFrame, spec: SequenceSpec | list[SequenceSpec], ts: str = "ts", seq: str = "seq",
                   keep: list[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """rule, key, start_ts, end_ts, events (one per step, oldest first) of every match.

    Several specs without bound fields share one scan and one shuffle.
    """
    specs = spec if isinstance(spec, list) else [spec]
    keep = list(keep)
    plain = [s for s in specs if not s.is_bound]
    groups = ([plain] if plain else []) + [[s] for s in specs if s.is_bound]
    out = None
    for group in groups:
        part = _match_group(df, group, ts, seq, keep, rows_per_slice)
        out = part if out is None else out.unionByName(part)
    return out


def _match_group(df: DataFrame, specs: list[SequenceSpec], ts: str, seq: str, keep: list[str], limit: int) -> DataFrame:
    tagged = tag_rows(df, specs, ts, seq, keep)
    fold = Fold(specs, tagged.schema["item"].dataType)
    by_key = tagged.groupBy("rule", "key")
    hot = (by_key.agg(F.count("*").alias("n"), F.min("item.ts").alias("t0"), F.max("item.ts").alias("t1"))
           .where(F.col("n") > limit * SLICES_BEFORE_CUT))
    # One small job; a hot key has more than 5 * ``limit`` rows, which bounds the list by rows / (5 * limit).
    hot = durable(hot)
    n_hot = hot.count()
    if fold.bound and fold.bound.by_value:
        found = _fold_by_value(tagged, hot if n_hot else None, fold.bound)
    elif n_hot == 0:
        found = _fold_whole(tagged, fold)
    else:
        if n_hot <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        cold = tagged.join(hot.select("rule", "key"), ["rule", "key"], "left_anti")
        sliced = _fold_repaired if fold.bound else _fold_sliced
        found = _fold_whole(cold, fold).unionByName(sliced(tagged, hot, fold, limit))
    return _report(found, fold, df, keep)


def _sorted_items() -> Column:
    return F.sort_array(F.collect_list("item")).alias("items")


def _fold_whole(tagged: DataFrame, fold: Fold) -> DataFrame:
    grouped = tagged.groupBy("rule", "key").agg(_sorted_items())
    return grouped.select("rule", "key", fold.run(F.col("items"), fold.idle(), F.col("rule"))["matches"].alias("matches"))


def _fold_sliced(tagged: DataFrame, hot: DataFrame, fold: Fold, limit: int) -> DataFrame:
    """Matches of hot keys: each slice folded once from its true entry."""
    rules = [slices.Rule(len(s.steps), s.ordered, s.span == "total", s.span_us) for s in fold.specs]
    chunk = ["rule", "key", "part", "slice"]
    parts = -(-hot.agg(F.sum("n")).first()[0] // (limit * SLICES_PER_PART))
    rows = tagged.join(hot.select("rule", "key"), ["rule", "key"], "left_semi").select("rule", "key", "item")
    in_order = ["rule", "key", "item.ts", "item.seq"]
    # Bounds of the ranges are sampled, so a burst of any width is spread like other rows; rows of equal time stay together.
    ranges = rows.repartitionByRange(parts, *in_order[:3]).sortWithinPartitions(*in_order)
    kind = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("slice", T.IntegerType())])
    grouped = durable(ranges.mapInArrow(lambda b: slices.cut(b, limit), kind).groupBy(*chunk).agg(_sorted_items()))
    entry = _entries(grouped, rules, parts)

    # A state names its events by slice and row; here they are fetched. Only open states have any: at most one event a step.
    named = entry.where("filled != 0").select(*chunk, F.posexplode("refs").alias("no", "ref"))
    home = grouped.select("rule", "key", F.col("part").alias("_part"), F.col("slice").alias("_slice"), F.col("items").alias("_items"))
    at_home = (named["rule"] == home["rule"]) & (named["key"] == home["key"]) & (F.col("ref.part") == F.col("_part")) & (F.col("ref.slice") == F.col("_slice"))
    fetched = named.join(home, at_home).select(*[named[c] for c in chunk], F.struct("no", F.get("_items", F.col("ref.row")).alias("item")).alias("x"))
    slots = fetched.groupBy(*chunk).agg(F.sort_array(F.collect_list("x")).alias("x")).select(*chunk, F.transform("x", lambda x: x["item"]).alias("slots"))
    opened = entry.where("filled != 0").select(*chunk, "filled", "entered", "started").join(slots, chunk)
    state = F.struct("filled", "entered", "started", F.col("entered").alias("last"), "slots")
    begun = grouped.join(opened, chunk, "left").select("rule", "key", "items", F.when(F.col("filled").isNotNull(), state).otherwise(fold.idle()).alias("entry"))
    return begun.select("rule", "key", fold.run(F.col("items"), F.col("entry"), F.col("rule"))["matches"].alias("matches"))


def _entries(grouped: DataFrame, rules: list[slices.Rule], parts: int) -> DataFrame:
    """State that enters each slice (``slices.ENTRY``): effects are composed up a tree, entries handed down it."""
    of = lambda name: F.transform("items", lambda x: x[name]).alias(name)
    seen = grouped.select("rule", "key", "part", "slice", of("ts"), of("mask"), of("ends"))
    blocks = durable(seen.mapInArrow(lambda b: slices.effects(b, rules), slices.EFFECT)).withColumn("block", F.col("part"))
    levels, wide = [blocks], parts
    while wide > 1:
        taken = blocks.groupBy("rule", "key", "block").applyInArrow(lambda k, t: slices.composed(t, rules, k[2].as_py()), slices.EFFECT)
        blocks = durable(taken).withColumn("block", F.floor(F.col("part") / BLOCKS_PER_STEP).cast("int"))
        levels.append(blocks)
        wide = -(-wide // BLOCKS_PER_STEP)
    # The blocks of the last level are all of a key's rows, which begin idle.
    entry = grouped.sparkSession.createDataFrame([], slices.ENTRY)
    for blocks in reversed(levels):
        entry = durable(blocks.groupBy("rule", "key", "block").cogroup(entry.groupBy("rule", "key", "part")).applyInArrow(
            lambda t, e: slices.entered(t, e, rules), slices.ENTRY))
    return entry


def asked_values(spec: SequenceSpec, item: Column, types: dict[str, T.DataType]) -> tuple[Column, Column]:
    """For each step with ``same``: the values it asks for, and those that an event has to offer it, as text; NULL where one is missing."""
    def text(name: str) -> Column:
        # Zero has two signs in floating point.
        return (item[name] + F.lit(0.0) if isinstance(types[name], (T.DoubleType, T.FloatType)) else item[name]).cast("string")

    def joined(names: list[str]) -> Column:
        values = [text(n) for n in names]
        known = and_(*[v.isNotNull() for v in values])
        return F.when(known, values[0] if len(values) == 1 else F.to_json(F.array(*values)))

    asking = [s for s in spec.steps if s.same]
    for here, there in {pair for s in asking for pair in s.same}:
        if types[here] != types[there]:
            raise ValueError(f"{spec.name}: {here} and {there} have different types")
    return F.array(*[joined([h for h, _ in s.same]) for s in asking]), F.array(*[joined([t for _, t in s.same]) for s in asking])


def _fold_by_value(tagged: DataFrame, hot: DataFrame | None, spec: SequenceSpec) -> DataFrame:
    """Matches of a sequence that asks for equal values: rows stream by in order, pending events held by value.

    A hot key is cut where it pauses: nothing stays open over a stretch of time
    as long as the lifetime without any row, so what follows begins idle. A key
    that never pauses is one stream through one task, which holds its open state.
    """
    types = {f.name: f.dataType for f in tagged.schema["item"].dataType}
    wants, haves = asked_values(spec, F.col("item"), types)
    stretch = F.floor(F.col("item.ts") / max(spec.span_us, 1))
    rows = tagged.withColumns({"stretch": stretch, "wants": wants, "haves": haves})
    if hot is None:
        rows = rows.withColumn("part", F.lit(0).cast("bigint"))
    else:
        # Stretches that hold a row are few: the time a key covers by the lifetime.
        in_order = Window.partitionBy("rule", "key").orderBy("stretch")
        held = rows.join(hot.select("rule", "key"), ["rule", "key"], "left_semi").groupBy("rule", "key", "stretch").agg(F.count(F.lit(1)).alias("n"))
        paused = F.when(F.col("stretch") - F.lag("stretch").over(in_order) > 1, 1).otherwise(0)
        parts = held.withColumn("paused", paused).select("rule", "key", "stretch", F.sum("paused").over(in_order).alias("part"))
        rows = rows.join(parts, ["rule", "key", "stretch"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    place = ["rule", "key", "part"]
    ordered = rows.select(*place, "item", "wants", "haves").repartition(*place).sortWithinPartitions(*place, "item")
    kind = T.StructType([tagged.schema["rule"], tagged.schema["key"], T.StructField("m", T.ArrayType(tagged.schema["item"].dataType))])
    terms = spec.terms
    return ordered.mapInArrow(lambda batches: bound.matches(batches, terms), kind).select("rule", "key", F.array("m").alias("matches"))


def _fold_repaired(tagged: DataFrame, hot: DataFrame, fold: Fold, limit: int) -> DataFrame:
    """Matches of hot keys of a sequence with bound fields: slices folded from a guess, and again where it was wrong."""
    keys, chunk = ["rule", "key"], ["rule", "key", "slice"]
    bins = F.ceil(F.col("n") / limit) * BINS_PER_SLICE
    bin_of = F.floor((F.col("item.ts") - F.col("t0")) * bins / (F.col("t1") - F.col("t0") + 1)).alias("bin")
    rows = tagged.join(hot, keys).select(*keys, "item", bin_of)
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    slices = (rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
              .select(*keys, "bin", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / limit).alias("slice")))
    grouped = durable(rows.join(slices, [*keys, "bin"]).groupBy(*chunk).agg(_sorted_items()))

    def folded(source: DataFrame) -> DataFrame:
        done = source.withColumn("res", fold.run(F.col("items"), F.col("entry"), F.col("rule")))
        return done.select(*chunk, F.get("items", F.lit(0))["ts"].alias("first_ts"), "entry",
                           F.col("res.state").alias("state"), F.col("res.matches").alias("matches"))

    table = durable(folded(grouped.withColumn("entry", fold.idle())))
    in_order = Window.partitionBy(*keys).orderBy("slice")
    while True:
        # Slices of a key form a short list (its rows / limit); states are a few fields each.
        handed = F.lag("state").over(in_order)
        usable = handed.isNotNull() & ~fold.expired(handed, F.col("first_ts"), F.col("rule"))
        stale = (table.select(*chunk, "first_ts", "entry", "state")
                 .select(*chunk, "entry", F.when(usable, handed).otherwise(fold.idle()).alias("truth"))
                 .where(~F.col("entry").eqNullSafe(F.col("truth"))).select(*chunk, F.col("truth").alias("entry")))
        stale = durable(stale)
        if stale.isEmpty():
            return table.select(*keys, "matches")
        kept = table.join(stale.select(*chunk), chunk, "left_anti")
        table = durable(kept.unionByName(folded(grouped.join(stale, chunk))))


def _report(found: DataFrame, fold: Fold, df: DataFrame, keep: list[str]) -> DataFrame:
    names = F.array(*[F.lit(s.name) for s in fold.specs])
    maps = {c for c in keep if isinstance(df.schema[c].dataType, T.MapType)}

    def event(e: Column) -> Column:
        fields = [F.timestamp_micros(e["ts"]).alias("ts"), e["seq"].alias("seq")]
        fields += [(F.map_from_entries(e[c]) if c in maps else e[c]).alias(c) for c in keep if c not in ("ts", "seq")]
        return F.struct(*fields)

    return (found.select("rule", "key", F.explode("matches").alias("m"))
            .select(F.get(names, F.col("rule")).alias("rule"), "key",
                    F.transform(F.sort_array("m"), event).alias("events"))
            .select("rule", "key", F.get("events", F.lit(0))["ts"].alias("start_ts"),
                    F.try_element_at("events", F.lit(-1))["ts"].alias("end_ts"), "events"))
