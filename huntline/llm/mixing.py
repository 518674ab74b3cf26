"""Mixing sources to target weights by systematic sampling.

A source's share of the mix is a number of words. Its documents stand in a
line; each adds the same number of expected copies (target / size of the
source) to a running sum that starts at one random offset, and is emitted once
for each whole number that the sum passes. The copies of a source so add up to
its expected number to within one.

The line runs through classes of similar size, so that what is taken from each
class, and with it the number of words, follows the target closely. A source
is cut into many (size class, hash) cells: positions are counted in the cells
and shifted by the cells before, so that no task sees a whole source.

Defined results: a null text has size 0; a null source is a source of its own,
last in the order; repeated rows each hold a place of their own; a mix without
words, or an empty table, emits nothing; extra columns go along, and those that
bear a name of the plan's are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import n_words, saved

CELLS = 64
TURNS = 8
LARGE = 100
MAX_COPIES = 3


def _code_points(source: str) -> Column:
    """Spark compares strings byte by byte in UTF-8, which is the order of their code points."""
    return F.col(source).asc_nulls_last()


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES) -> DataFrame:
    """sizes (source, source_size, one row per source) with ``target``.

    Weights repeat along the order of the sources. A target stops at cap times
    the source's size; what is above goes to the others by weight. The end of
    that process has a closed form: sources reach their stop in the order of
    stop / weight. If the first k stop, the others share what is left at a level
    (words per unit of weight) that is never above the true one and is the true
    one for the right k: the largest level is the one sought.
    """
    line = W.orderBy(_code_points("source"))
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(line) - 1) % len(weights) + 1).cast("int")))
    everything = W.partitionBy()
    stop = (cap * F.col("source_size")).cast("double")
    by_ratio = W.orderBy("_ratio", _code_points("source")).rowsBetween(W.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_ratio", stop / F.col("_w"))
        .withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(stop).over(by_ratio), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_ratio), F.lit(0))))
    )
    level = F.max("_level").over(everything)
    return levels.withColumn("target", F.coalesce(F.least(stop, F.col("_w") * level), stop)).drop("_w", "_ratio", "_level")


def _crossed(offset: Column, rate: Column) -> Column:
    """Whole numbers that the running sum passes at a row."""
    place = F.col("before") + F.col("at")
    return F.floor(offset + place * rate) - F.floor(offset + (place - 1) * rate)


def _placed(docs: DataFrame, seed: int, key: str, text: str, source: str, cells: int) -> DataFrame:
    """docs as ``row`` with size, source key, size class, cell and the place in the cell."""
    half = F.greatest(F.length(F.bin("size")) - 4, F.lit(0))  # sizes in a class differ by an eighth at most
    sized = (
        docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
        # What rows are joined by is never null, and known not to be: a test for nulls would count the words of each text again.
        .withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")))
        .withColumn("hash", F.xxhash64(F.lit(seed), "key", "size"))
        .withColumns({
            "class": F.coalesce((half * 16 + F.floor(F.col("size") / F.pow(F.lit(2.0), half))).cast("int"), F.lit(0)),
            "cell": F.coalesce(F.pmod("hash", F.lit(cells)).cast("int"), F.lit(0)),
        })
    )
    return sized.withColumn("at", F.row_number().over(W.partitionBy("of", "class", "cell").orderBy("size", "hash", "key")))


def _best_turn(slim: DataFrame, starts: DataFrame, goals: DataFrame, seed: int, turns: int) -> DataFrame:
    """(of, offset, took): the rotation of a source's seeded offset whose words come closest to its goal (of, goal, rate)."""

    def rotated(turn: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("of")) + F.lit((turn << 30) // turns), F.lit(1 << 30)) / F.lit(float(1 << 30))

    rows = slim.join(starts.join(goals, "of"), ["of", "class", "cell"])
    tried = rows.groupBy("of").agg(F.first("goal").alias("goal"), *[F.sum(_crossed(rotated(t), F.col("rate")) * F.col("size")).alias(f"t{t}") for t in range(turns)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{t}") - F.col("goal")).alias("off"), F.lit(t).alias("turn"), rotated(t).alias("offset"), F.col(f"t{t}").alias("took")) for t in range(turns)]))
    return tried.select("of", best["offset"].alias("offset"), best["took"].alias("took"))


def plan(docs: DataFrame, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES, cells: int = CELLS, turns: int = TURNS, large: int = LARGE) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target`` and ``copies``.

    A rerun gives the same copies: places in the line depend on key, size and
    seed alone, and rows equal in these are interchangeable. A source's large
    documents (classes above one `large`-th of its target) form a line of their
    own, drawn first; the expected copies of the others make up for what these
    took. Each line's random offset is one of `turns` rotations of a seeded
    number, the one whose words come closest to what the line should give.
    """
    new = ["size", "source_size", "target", "copies"]
    options = dict(seed=seed, key=key, text=text, source=source, cells=cells)
    slim = saved(_placed(docs.select(key, text, source), **options).select("source", "of", "class", "cell", "size", "at"), "mix-sizes")
    counted = slim.groupBy("of", "source", "class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("size").alias("least"))
    shares = targets(counted.groupBy("of", "source").agg(F.sum("words").alias("source_size")), weights, cap).drop("source")
    shares = shares.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    classes = counted.groupBy("of", "class").agg(F.min("least").alias("least")).join(shares.select("of", "target"), "of").select("of", "class", (F.col("least") * large > F.col("target")).alias("is_large"))
    line = W.partitionBy("of", "is_large").orderBy("class", "cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.join(classes, ["of", "class"]).withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0))).select("of", "class", "cell", "words", "is_large", "before")
    starts = saved(starts, "mix-cells")

    drawn_first, others = starts.filter("is_large"), starts.filter(~F.col("is_large"))
    size_of = lambda s: s.groupBy("of").agg(F.sum("words").alias("line_size"))
    goals = shares.join(size_of(drawn_first), "of").select("of", "rate", (F.col("rate") * F.col("line_size")).alias("goal"))
    first = _best_turn(slim, drawn_first, goals, seed, turns)
    left = F.col("target") - F.coalesce(F.col("took"), F.lit(0))
    goals_left = shares.drop("rate").join(size_of(others), "of").join(first, "of", "left").select(
        "of", left.alias("goal"), F.when(F.col("line_size") > 0, F.least(F.greatest(left / F.col("line_size"), F.lit(0.0)), F.lit(float(cap)))).otherwise(0.0).alias("rate")
    )
    second = _best_turn(slim, others, goals_left, seed, turns)
    lines = goals.join(first, "of").select("of", F.lit(True).alias("is_large"), "rate", "offset").union(goals_left.join(second, "of").select("of", F.lit(False), "rate", "offset"))
    settled = saved(starts.join(lines, ["of", "is_large"]).join(shares.drop("rate"), "of").drop("words", "is_large"), "mix-plan")
    joined = _placed(docs, **options).join(settled, ["of", "class", "cell"])
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new]
    return joined.select(*own, "size", "source_size", "target", _crossed(F.col("offset"), F.col("rate")).cast("long").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    planned = plan(whole, key="key", text="text", source="source", **options).filter(F.col("copies") > 0)
    return planned.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
