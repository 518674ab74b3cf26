"""Latest-row joins: as-of, range, nearest-below and one-to-one pairing.

All of them ask for the last right row at or before a position (time, address,
offset) within the same key. Rows of both sides are brought together once and
a running ``last`` answers; no pair of rows is ever built. Rows without a key
can meet nothing; a salt spreads them, so they travel with the others in one
pass. ``lookups`` answers several keys of a row from several tables at once.

A key that owns a large part of the data is cut into slices of the position
axis, so that it spreads over many tasks; what a slice inherits from earlier
slices comes from one summary row per key and slice. Which keys are hot is
found by one count over the key columns (partial aggregation); with a given
``slice_width`` every key is cut and nothing is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..durations import micros
from ..session import durable

ROWS_PER_SLICE = 2_000_000
BROADCAST_ROWS = 100_000


def _micros_of(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)


def last_at_or_before(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column,
                      columns: list[str], width: int | None = None, tie: str | None = None,
                      ends: DataFrame | None = None, ends_at: Column | None = None,
                      ends_shown_at: Column | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``left`` plus ``_st`` (position and columns of the last right row) and ``_end`` (position of the last end row).

    ``width`` is the slice length on the position axis; every width gives the
    same result. End rows take effect after left rows at their shown position.
    Left rows without a key meet nothing.
    """
    order_tie = F.col(tie) if tie else F.lit(0)
    state = F.struct(right_at.alias("_from"), *[F.col(c) for c in columns])
    parts = [
        left.select("*", left_at.alias("_pos"), F.lit(1).alias("_tag"), F.lit(0).cast("bigint").alias("_tie")),
        right.select(*keys, right_at.alias("_pos"), F.lit(0).alias("_tag"), order_tie.cast("bigint").alias("_tie"),
                     state.alias("_state")).where(_present(keys)),
    ]
    if ends is not None:
        shown = ends_shown_at if ends_shown_at is not None else ends_at
        parts.append(ends.select(*keys, shown.alias("_pos"), F.lit(2).alias("_tag"), F.lit(0).cast("bigint").alias("_tie"),
                                 ends_at.alias("_over")).where(_present(keys)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    if ends is None:
        together = together.withColumn("_over", F.lit(None).cast("bigint"))
    together = together.withColumn("_salt", _salt(keys))

    if width is not None:
        together = together.withColumn("_slice", F.floor(F.col("_pos") / F.lit(width)))
    else:
        hot = _hot_keys(together, keys, rows_per_slice)
        if hot is None:
            near = _running(together, [*keys, "_salt"])
            return near.select(*left.columns, F.col("_near").alias("_st"), F.col("_near_over").alias("_end"))
        together = together.join(hot, keys, "left").withColumn(
            "_slice", F.when(F.col("_w").isNotNull(), F.floor(F.col("_pos") / F.col("_w"))).otherwise(F.lit(0)))

    near = _running(together, [*keys, "_salt", "_slice"])
    sliced = together if width is not None else together.where("_w is not null")
    joined = near.join(_inherited(sliced.where(_present(keys)), keys), [*keys, "_slice"], "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        F.coalesce("_near", "_far").alias("_st"), F.coalesce("_near_over", "_far_over").alias("_end"))


def _running(together: DataFrame, group: list[str]) -> DataFrame:
    """Left rows with the last state and end row before them in their group."""
    before = (Window.partitionBy(*group).orderBy("_pos", "_tag", "_tie")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return together.select("*", F.last("_state", True).over(before).alias("_near"),
                           F.last("_over", True).over(before).alias("_near_over")).where("_tag = 1")


def _inherited(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and slice with left rows: the last state and end row of all earlier slices."""
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.when(F.col("_tag") == 0, F.struct("_pos", "_tie"))
    return (
        rows.groupBy(*keys, "_slice")
        .agg(F.max_by("_state", newest).alias("_s"), F.max("_over").alias("_o"), F.count_if(F.col("_tag") == 1).alias("_n"))
        .select(*keys, "_slice", "_n", F.last("_s", True).over(earlier).alias("_far"),
                F.max("_o").over(earlier).alias("_far_over"))
        .where("_n > 0 and (_far is not null or _far_over is not null)").drop("_n")
    )


def _hot_keys(together: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows and their slice length ``_w``; at most rows / limit of them, None if there are none."""
    counted = together.where(_present(keys)).groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_pos").alias("_a"), F.max("_pos").alias("_b")).where(F.col("_n") > limit)
    pieces = F.ceil(F.col("_n") / limit)
    hot = durable(counted.select(*keys, F.greatest((F.col("_b").cast("double") - F.col("_a").cast("double")) / pieces, F.lit(1.0)).alias("_w")))
    found = hot.count()
    if found == 0:
        return None
    return F.broadcast(hot) if found <= BROADCAST_ROWS else hot


def _salt(keys: list[str]) -> Column:
    """0 for rows with a key; the others, which meet nothing, in many groups."""
    return F.when(_present(keys), F.lit(0)).otherwise(F.pmod(F.xxhash64("_pos"), F.lit(4096)) + 1)


def _present(keys: list[str]) -> Column:
    out = F.lit(True)
    for key in keys:
        out = out & F.col(key).isNotNull()
    return out


def _width(value: str | int | None) -> int | None:
    return None if value is None else micros(value)


def _spread(df: DataFrame, left_columns: list[str], columns: list[str], ok: Column, extra: list[Column] = ()) -> DataFrame:
    return df.select(*left_columns, *[F.when(ok, F.col("_st")[c]).alias(c) for c in columns], *extra)


def asof_join(left: DataFrame, state: DataFrame, keys: list[str], ts: str, columns: list[str], state_ts: str | None = None,
              close: DataFrame | None = None, close_ts: str | None = None, grace: str | int = 0,
              slice_width: str | int | None = None, tie: str | None = None) -> DataFrame:
    """Columns of the latest state row of the same key with ``state_ts <= ts``.

    ``close`` rows end the state; it stays visible for ``grace`` after the end.
    """
    state_ts, close_ts = state_ts or ts, close_ts or ts
    found = last_at_or_before(
        left, state, keys, _micros_of(left, ts), _micros_of(state, state_ts), columns, _width(slice_width), tie,
        ends=close, ends_at=None if close is None else _micros_of(close, close_ts),
        ends_shown_at=None if close is None else _micros_of(close, close_ts) + F.lit(micros(grace)))
    alive = F.col("_end").isNull() | (F.col("_end") < F.col("_st")["_from"])
    return _spread(found, left.columns, columns, F.coalesce(alive, F.lit(False)))


@dataclass(frozen=True)
class Source:
    """A table to look things up in: states with keys and position; ``ends`` close a state, which shows for ``grace`` longer."""

    rows: DataFrame
    keys: list[str]
    at: Column
    columns: list[str]
    tie: str | None = None
    ends: DataFrame | None = None
    ends_at: Column | None = None
    grace: int = 0


def lookups(left: DataFrame, at: Column, asked: dict[str, list[str]], sources: dict[str, Source],
            slice_width: int | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``left`` plus a struct ``{ask}_{source}`` for each: position (``_from``) and columns of the last state at or before ``at``, if it is open.

    Each row asks under several keys (of one type) at once. It travels as one
    row for each key it has, the first of which carries its columns; keys that
    are NULL produce none. All keys and tables meet in one exchange and one
    pass, and a second exchange brings the answers of a row together. ``left``
    is read once. Rows are told apart by two hashes of all their columns; equal
    rows get equal answers and are repeated as often as they came.
    """
    n_keys = len(next(iter(asked.values())))
    keys = [f"_k{i}" for i in range(n_keys)]
    identity = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in left.schema.fields]
    asks = F.array(*[F.when(_present(names), F.struct(F.lit(i).alias("ask"), *[F.col(c).alias(k) for c, k in zip(names, keys)])) for i, names in enumerate(asked.values())])
    home = left.select(F.xxhash64(*identity).alias("_h1"), F.xxhash64(F.lit(1), *identity).alias("_h2"), at.alias("_pos"), F.struct(*left.columns).alias("_row"), asks.alias("_asks"))
    home = home.select("_h1", "_h2", "_pos", "_row", F.posexplode_outer(F.filter("_asks", lambda x: x.isNotNull())).alias("_no", "_x"))
    tie = lambda c: c.cast("bigint").alias("_tie")
    parts = [home.select("_h1", "_h2", "_pos", F.when(F.coalesce("_no", F.lit(0)) == 0, F.col("_row")).alias("_row"), F.col("_x.ask").alias("_ask"),
                         *[F.col(f"_x.{k}").alias(k) for k in keys], F.lit(1).alias("_tag"), tie(F.lit(0)), F.lit(-1).alias("_src"))]
    for j, source in enumerate(sources.values()):
        named = [F.col(c).alias(k) for c, k in zip(source.keys, keys)]
        state = F.struct(source.at.alias("_from"), *source.columns)
        parts.append(source.rows.select(*named, source.at.alias("_pos"), F.lit(0).alias("_tag"), tie(F.col(source.tie) if source.tie else F.lit(0)), F.lit(j).alias("_src"), state.alias(f"_s{j}")).where(_present(keys)))
        if source.ends is not None:
            parts.append(source.ends.select(*named, (source.ends_at + F.lit(source.grace)).alias("_pos"), F.lit(2).alias("_tag"), tie(F.lit(0)), F.lit(j).alias("_src"), source.ends_at.alias(f"_o{j}")).where(_present(keys)))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    together = together.withColumn("_salt", F.when(F.col("_tag") != 1, F.lit(0)).otherwise(F.when(F.col("_ask").isNull(), F.pmod("_h1", F.lit(4096)) + 1).otherwise(F.lit(0))))
    kept = [c for j, source in enumerate(sources.values()) for c in ([f"_s{j}", f"_o{j}"] if source.ends is not None else [f"_s{j}"])]

    if slice_width is not None:
        together = together.withColumn("_slice", F.floor(F.col("_pos") / F.lit(slice_width)))
        sliced = together
    else:
        hot = _hot_keys(together, keys, rows_per_slice)
        if hot is None:
            together, sliced = together.withColumn("_slice", F.lit(0)), None
        else:
            together = together.join(hot, keys, "left").withColumn("_slice", F.when(F.col("_w").isNotNull(), F.floor(F.col("_pos") / F.col("_w"))).otherwise(F.lit(0)))
            sliced = together.where("_w is not null")
    before = Window.partitionBy(*keys, "_salt", "_slice").orderBy("_pos", "_tag", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = together.select("_h1", "_h2", "_row", "_ask", "_tag", *keys, "_slice", *[F.last(c, True).over(before).alias(c) for c in kept]).where("_tag = 1")
    if sliced is not None:
        far = _inherited_many(sliced.where(_present(keys)), keys, kept)
        found = found.join(far, [*keys, "_slice"], "left").select("_h1", "_h2", "_row", "_ask", *[F.coalesce(c, f"_far{c}").alias(c) for c in kept])

    def alive(j: int, source: Source) -> Column:
        state = F.col(f"_s{j}")
        return state if source.ends is None else F.when(F.col(f"_o{j}").isNull() | (F.col(f"_o{j}") < state["_from"]), state)

    answers = [F.first(F.when(F.col("_ask") == i, alive(j, source)), True).alias(f"{ask}_{name}") for i, ask in enumerate(asked) for j, (name, source) in enumerate(sources.items())]
    whole = found.groupBy("_h1", "_h2").agg(F.first("_row", True).alias("_row"), F.count("_row").alias("_copies"), *answers)
    out = whole.select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row"), *[F.col(f"{a}_{n}") for a in asked for n in sources])
    return out.select("_row.*", *[F.col(f"{a}_{n}") for a in asked for n in sources])


def _inherited_many(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Per key and slice: the last state and end row of each source in all earlier slices."""
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("_pos", "_tie"))) if c.startswith("_s") else F.max(c)
    far = lambda c: F.last(c, True).over(earlier) if c.startswith("_s") else F.max(c).over(earlier)
    return rows.groupBy(*keys, "_slice").agg(*[newest(c).alias(c) for c in kept]).select(*keys, "_slice", *[far(c).alias(f"_far{c}") for c in kept])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], point: str, lo: str, size: str, columns: list[str],
               slice_width: int | None = None) -> DataFrame:
    """Columns of the right interval ``[lo, lo + size)`` that holds ``point``; intervals of a key do not overlap."""
    needed = list(dict.fromkeys([*columns, size]))
    right = right.withColumn("_lo", F.col(lo))
    found = last_at_or_before(left, right, keys, F.col(point), F.col("_lo"), needed, slice_width)
    inside = F.coalesce(F.col(point) < F.col("_st")["_from"] + F.col("_st")[size], F.lit(False))
    return _spread(found, left.columns, columns, inside)


def nearest_below_join(left: DataFrame, right: DataFrame, keys: list[str], point: str, at: str, columns: list[str],
                       slice_width: int | None = None) -> DataFrame:
    """Columns of the right row with the largest ``at <= point``."""
    right = right.withColumn("_at", F.col(at))
    found = last_at_or_before(left, right, keys, F.col(point), F.col("_at"), columns, slice_width)
    return _spread(found, left.columns, columns, F.lit(True))


def pair_latest(left: DataFrame, right: DataFrame, keys: list[str], ts: str, within: str | int, columns: list[str],
                right_ts: str | None = None, left_id: str = "seq", right_id: str = "seq", same: list[str] = (),
                one_to_one: bool = True, slice_width: str | int | None = None) -> DataFrame:
    """Pair each left row with the newest earlier right row of its key, at most ``within`` old.

    ``same`` names columns that must agree as well. With ``one_to_one`` a right
    row serves only the first left row that qualifies; only the newest pending
    right row of a key is ever considered.
    """
    right_ts = right_ts or ts
    carried = right.withColumnsRenamed({c: f"_r_{c}" for c in same})
    carried = carried.withColumn("_rid", F.col(right_id))
    found = last_at_or_before(left, carried, keys, _micros_of(left, ts), _micros_of(carried, right_ts),
                              list(dict.fromkeys([*columns, "_rid", *[f"_r_{c}" for c in same]])), _width(slice_width),
                              tie="_rid")
    fits = _micros_of(left, ts) - F.col("_st")["_from"] <= F.lit(micros(within))
    for c in same:
        fits = fits & (F.col(c) == F.col("_st")[f"_r_{c}"])
    fits = F.coalesce(fits, F.lit(False))
    paired = found.withColumn("_fits", fits)
    if not one_to_one:
        return _spread(paired, left.columns, columns, F.col("_fits"))
    # The consumer of a right row is the first fitting left row; one row per right row, found by partial aggregation.
    # Ids are unique within a key only (hosts number their events themselves), so the key is part of both.
    first = (paired.where("_fits").groupBy(*keys, F.col("_st._rid").alias("_used"))
             .agg(F.min(F.struct(F.col(ts).alias("t"), F.col(left_id).alias("i"))).alias("_first"))
             .select(*keys, F.col("_first.i").alias(left_id), F.lit(True).alias("_mine")))
    marked = paired.join(first, [*keys, left_id], "left").select(*paired.columns, "_mine")
    return _spread(marked, left.columns, columns, F.coalesce("_mine", F.lit(False)))
