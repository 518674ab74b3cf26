"""Hard negatives by exact inner products, with length buckets and sorted coordinate lists (after LEMP).

For each anchor, the `n_positives` best rows of its label are its positives.
For each positive, the `n_negatives` best rows of other labels are returned
whose score lies between `low` and `high` hundredths of the positive's score.

1. Components become floor(scale * x). Rows are partitioned by ranges of their
   length, longest first, and cut into buckets; a bucket holds its rows as a
   matrix and, for each coordinate, its row numbers sorted by the unit vector's
   value there. Some buckets, following each other, are a group; a group is
   what a task holds.
2. A search asks each anchor for the best k rows within score limits. Groups
   whose longest row can't reach the anchor's lowest limit never receive it. In
   a task, buckets come longest first, and what the anchor has found raises its
   limit. The limit divided by both lengths is the least cosine; it gives, for
   each of the anchor's largest coordinates (focus), the values that a row may
   have there. The narrowest of these stretches of the sorted lists, filtered by
   the others, are the candidates, and their exact scores decide. Where the
   stretches hold most of a bucket, its scores come from one matrix product.
3. Positives are searched twice: the group of the longest rows gives each anchor
   a limit, and with that limit the other groups are searched. Negatives have
   their limits from the positives' scores.

Each task answers with at most k rows for each anchor and limit. Nothing is
approximate. The driver holds a few numbers for each group (`group_rows` rows).

Defined results: rows with a null id or label, a null or empty vector, or a null
or non-finite component take no part; a repeated row (same id, label and vector)
is one row; a row is no positive of an anchor with the same id; missing trailing
components of shorter vectors are 0; positives with a negative score have no
negatives; scores are exact as long as they stay below 2^53, and kept as the
nearest long beyond it; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
FOCUS = 3
BUCKET_ROWS = 4096
GROUP_ROWS = 32768
ANCHOR_ROWS = 4096
#: Anchors scored at once where candidates are most of a bucket.
DENSE = 64
#: Above this share of a bucket, candidates are scored by one product for many anchors.
MOST = 0.25
NO_LIMIT = float(np.finfo(np.float64).max)


def usable(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(id, label, vec, row): the rows that take part; row tells them apart."""
    vec = F.col(vector).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = rows.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)
    return known.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vec.alias("vec"), F.xxhash64(vec_id, label, vector).alias("row"))


def scaled(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Vectors as packed doubles floor(scale * x), with their length and dimension."""
    for batch in batches:
        vecs = batch.column("vec")
        flat = np.floor(np.asarray(vecs.flatten()) * scale)
        ends = np.cumsum(np.asarray(vecs.value_lengths()))
        parts = np.split(flat, ends[:-1]) if batch.num_rows else []
        norms = [float(np.sqrt(p @ p)) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), batch.column("row"), pa.array(norms), pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["id", "label", "row", "norm", "dim", "vec"])


POINT = "id long, label long, row long, norm double, dim int, vec binary"


def matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim))
    for i, v in enumerate(vecs):
        v = np.frombuffer(v)
        out[i, : len(v)] = v
    return out


@dataclass
class Bucket:
    """Rows of similar length, with the sorted list of each coordinate."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    unit: np.ndarray
    order: np.ndarray
    sorted: np.ndarray
    longest: float

    @staticmethod
    def lists(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        unit = points / np.where(norms > 0, norms, 1)[:, None]
        return unit, np.argsort(unit, axis=0, kind="stable").astype(np.int32)

    @classmethod
    def read(cls, row: dict) -> Bucket:
        dim = row["dim"]
        points = np.frombuffer(row["points"], row["kind"]).reshape(-1, dim).astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", points, points))
        unit = points / np.where(norms > 0, norms, 1)[:, None]
        order = np.frombuffer(row["lists"], np.int32).reshape(-1, dim)
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), points, unit, order, np.take_along_axis(unit, order, 0), row["longest"])


BUCKET = "part int, bucket int, longest double, dim int, rows int, kind string, ids binary, labels binary, points binary, lists binary"


def _kind(points: np.ndarray) -> str:
    top = np.abs(points).max(initial=0)
    return "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"


def _buckets(batches: Iterator[pa.RecordBatch], bucket_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of one range, sorted by length (longest first), cut into buckets; repeated rows are left out."""
    rest, number, last = None, 0, None

    def told(t: pa.Table) -> pa.RecordBatch:
        nonlocal number
        dim = int(np.asarray(t.column("dim")).max())
        points = matrix(t.column("vec").to_pylist(), dim)
        kind, (_, order) = _kind(points), Bucket.lists(points)
        number += 1
        return pa.RecordBatch.from_pylist([{
            "bucket": number, "longest": float(np.asarray(t.column("norm")).max()), "dim": dim, "rows": t.num_rows, "kind": kind, "ids": np.asarray(t.column("id")).tobytes(),
            "labels": np.asarray(t.column("label")).tobytes(), "points": points.astype(kind).tobytes(), "lists": order.tobytes(), "part": part}], _BUCKET_TYPE)

    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(np.asarray(batch.column(c)) for c in ("norm", "id", "row")), strict=True))
        new = [k != before for k, before in zip(keys, [last, *keys], strict=False)]
        last = keys[-1]
        t = pa.Table.from_batches([batch]).filter(pa.array(new))
        rest = t if rest is None else pa.concat_tables([rest, t])
        while rest.num_rows >= bucket_rows:
            yield told(rest.slice(0, bucket_rows).combine_chunks())
            rest = rest.slice(bucket_rows)
    if rest is not None and rest.num_rows:
        yield told(rest.combine_chunks())


_BUCKET_TYPE = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("longest", pa.float64()), ("dim", pa.int32()), ("rows", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                          ("labels", pa.binary()), ("points", pa.binary()), ("lists", pa.binary())])


#: Greatest length in each group, longest first: the number of a group is its place.
Groups = list[float]


def index(points: DataFrame, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, Groups]:
    """(grp, bucket, …) rows of the buckets as a table, and the greatest length in each group."""
    groups = max(1, -(-points.count() // group_rows))
    ranges = points.repartitionByRange(groups, F.col("norm").desc(), "id", "row").sortWithinPartitions(F.col("norm").desc(), "id", "row")
    table = saved(ranges.mapInArrow(lambda b: _buckets(b, bucket_rows), BUCKET), "buckets")
    # Range bounds are sampled: a range may hold more than a group should, or much less.
    per_group = max(1, group_rows // bucket_rows)
    table = table.withColumn("sub", F.floor((F.col("bucket") - 1) / per_group).cast("int"))
    lots = table.groupBy("part", "sub").agg(F.max("longest").alias("longest"), F.sum("rows").alias("rows")).orderBy("part", "sub").collect()
    places, longest, held = [], [], group_rows
    for lot in lots:
        if held + lot.rows > group_rows:
            longest.append(lot.longest)
            held = 0
        held += lot.rows
        places.append((lot.part, lot.sub, len(longest) - 1))
    placed = points.sparkSession.createDataFrame(places, "part int, sub int, grp int")
    return table.join(F.broadcast(placed), ["part", "sub"]), longest


# --- search ----------------------------------------------------------------

QUERY = "id long, label long, row long, norm double, dim int, vec binary, floors array<double>, ceilings array<double>"
FOUND = "row long, slot int, id long, score double"


def _routed(batches: Iterator[pa.RecordBatch], groups: Groups, only: slice) -> Iterator[pa.RecordBatch]:
    """Each anchor once for every group whose longest row may reach its lowest limit."""
    numbers, longest = np.arange(len(groups), dtype=np.int32)[only], np.array(groups[only])
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            piece = batch.slice(a, 256)
            lowest = np.array([min(f) for f in piece.column("floors").to_pylist()])
            reach = np.asarray(piece.column("norm"))[:, None] * longest[None, :] * (1 + 1e-9) >= lowest[:, None]
            at, grp = np.nonzero(reach | (lowest <= 0)[:, None])
            out = piece.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(numbers[grp]), *out.columns], ["grp", *out.schema.names])


class _Best:
    """The best k of one anchor within one pair of score limits, by score and then id."""

    def __init__(self, floor: float, ceiling: float, k: int):
        self.floor, self.ceiling, self.k = floor, ceiling, k
        self.scores, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = (scores >= self.floor) & (scores <= self.ceiling)
        if not fits.any():
            return
        scores, ids = np.concatenate([self.scores, scores[fits]]), np.concatenate([self.ids, ids[fits]])
        if len(scores) > 64 + self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.floor = max(self.floor, float(self.scores[-1]))


def feasible(q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values that a coordinate of a unit vector may have, if its cosine with a unit vector of value q there is at least `least` (> 0)."""
    spread = np.sqrt(np.maximum(0, 1 - q * q)) * np.sqrt(np.maximum(0, 1 - least * least))
    low = np.where(-q >= least, -1.0, q * least - spread)
    high = np.where(q >= least, 1.0, q * least + spread)
    return low - 1e-9, high + 1e-9


def _candidates(bucket: Bucket, unit: np.ndarray, least: float, focus: int) -> np.ndarray | None:
    """Rows within the feasible values of the anchor's focus coordinates; None if they are most of the bucket."""
    at = np.argsort(-np.abs(unit), kind="stable")[:focus]
    low, high = feasible(unit[at], np.full(len(at), least))
    begins = np.array([np.searchsorted(bucket.sorted[:, f], x, "left") for f, x in zip(at, low, strict=True)])
    ends = np.array([np.searchsorted(bucket.sorted[:, f], x, "right") for f, x in zip(at, high, strict=True)])
    narrow = int(np.argmin(ends - begins))
    if ends[narrow] - begins[narrow] > MOST * len(bucket.ids):
        return None
    rows = bucket.order[begins[narrow] : ends[narrow], at[narrow]]
    for j, f in enumerate(at):
        if j != narrow:
            value = bucket.unit[rows, f]
            rows = rows[(value >= low[j]) & (value <= high[j])]
    return rows


def _search(table: pa.Table, buckets: list[Bucket], same: bool, k: int, focus: int) -> pa.Table:
    """FOUND rows of some anchors in one group."""
    ids, labels, rows = (np.asarray(table.column(c)) for c in ("id", "label", "row"))
    dim = max([0, *(b.points.shape[1] for b in buckets), *table.column("dim").to_pylist()])
    anchors = matrix(table.column("vec").to_pylist(), dim)
    norms = np.sqrt(np.einsum("ij,ij->i", anchors, anchors))
    units = anchors / np.where(norms > 0, norms, 1)[:, None]
    best = [[_Best(f, c, k) for f, c in zip(fs, cs, strict=True)] for fs, cs in zip(table.column("floors").to_pylist(), table.column("ceilings").to_pylist(), strict=True)]

    def settle(a: int, scores: np.ndarray, among: np.ndarray | None, bucket: Bucket) -> None:
        lowest, highest = min(b.floor for b in best[a]), max(b.ceiling for b in best[a])
        fits = (scores >= lowest) & (scores <= highest)
        at = np.flatnonzero(fits)
        of = at if among is None else among[at]
        right = (bucket.labels[of] == labels[a]) & (bucket.ids[of] != ids[a]) if same else bucket.labels[of] != labels[a]
        scores, found = scores[at[right]], bucket.ids[of[right]]
        if len(found):
            for b in best[a]:
                b.add(scores, found)

    for bucket in sorted(buckets, key=lambda b: -b.longest):
        width, dense = bucket.points.shape[1], []
        for a in range(len(ids)):
            lowest = min(b.floor for b in best[a])
            if lowest > 0:
                reach = norms[a] * bucket.longest
                if reach * (1 + 1e-9) < lowest:
                    continue
                chosen = _candidates(bucket, units[a, :width], min(1.0, lowest / reach), focus)
                if chosen is not None:
                    if len(chosen):
                        settle(a, bucket.points[chosen] @ anchors[a, :width], chosen, bucket)
                    continue
            dense.append(a)
        for i in range(0, len(dense), DENSE):
            some = dense[i : i + DENSE]
            scores = anchors[some, :width] @ bucket.points.T
            for a, s in zip(some, scores, strict=True):
                settle(a, s, None, bucket)
    told = [(rows[a], slot, i, s) for a, slots in enumerate(best) for slot, b in enumerate(slots) for i, s in zip(b.ids, b.scores, strict=True)]
    columns = list(zip(*told, strict=True)) or [[], [], [], []]
    return pa.table({"row": pa.array(columns[0], pa.int64()), "slot": pa.array(columns[1], pa.int32()), "id": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})


def search(queries: DataFrame, table: DataFrame, groups: Groups, same: bool, k: int, blocks: int, only: slice = slice(None), focus: int = FOCUS) -> DataFrame:
    """(row, slot, id, score): for each query (QUERY) and pair of limits, at most k rows of each group, the best among them."""
    routed = queries.mapInArrow(lambda b: _routed(b, groups, only), f"grp int, {QUERY}").withColumn("block", F.pmod(F.col("row"), F.lit(blocks).cast("long")))
    keys = ["grp", "block"]
    copies = table.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "longest", "dim", "kind", "ids", "labels", "points", "lists")

    def task(index: pa.Table, anchors: pa.Table) -> pa.Table:
        return _search(anchors, [Bucket.read(r) for r in index.to_pylist()] if anchors.num_rows else [], same, k, focus)

    return copies.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(task, FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k of all groups, numbered from 1."""
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, scale: int = SCALE, bucket_rows: int = BUCKET_ROWS, group_rows: int = GROUP_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors is a condition on rows."""
    asked = F.coalesce(anchors, F.lit(False))
    known = usable(rows, vec_id, vector, label)
    points = saved(known.mapInArrow(lambda b: scaled(b, scale), POINT), "points")
    table, groups = index(points, bucket_rows, group_rows)
    limits = lambda x: F.array(F.lit(x).cast("double"))
    chosen = saved(usable(rows.filter(asked), vec_id, vector, label).mapInArrow(lambda b: scaled(b, scale), POINT).dropDuplicates(["row"]), "anchors")
    blocks = max(1, -(-chosen.count() // anchor_rows))

    first = chosen.select("*", limits(-NO_LIMIT).alias("floors"), limits(NO_LIMIT).alias("ceilings"))
    seeds = saved(search(first, table, groups, True, n_positives, blocks, slice(0, 1)), "seeds")
    reached = seeds.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= n_positives).select("row", "least")
    second = chosen.join(reached, "row", "left").select(*chosen.columns, F.array(F.coalesce("least", F.lit(-NO_LIMIT))).alias("floors"), limits(NO_LIMIT).alias("ceilings"))
    found = seeds.union(search(second, table, groups, True, n_positives, blocks, slice(1, None))) if len(groups) > 1 else seeds
    positives = saved(_top(found, n_positives).select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # One pair of limits for each positive, in its place; a positive below 0 has none that can be met.
    met = F.col("positive_score") >= 0
    floor = F.when(met, F.ceil(F.col("positive_score") * low / 100).cast("double")).otherwise(NO_LIMIT)
    ceiling = F.when(met, F.floor(F.col("positive_score") * high / 100).cast("double")).otherwise(-NO_LIMIT)
    listed = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", floor.alias("f"), ceiling.alias("c")))).alias("l"))
    third = chosen.join(listed, "row").select(*chosen.columns, F.col("l.f").alias("floors"), F.col("l.c").alias("ceilings"))
    negatives = _top(search(third, table, groups, False, n_negatives, blocks), n_negatives)
    told = negatives.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["row", "slot"]).join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("positive_score").cast("long").alias("positive_score"), F.col("negative_score").cast("long").alias("negative_score"))
