"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import saved_with


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node with a link; label is the smallest node of its component.

    Alternating large-star and small-star rounds: minima are aggregated before
    the shuffle and joined back, so a node with very many links is a skewed
    join side, which Spark splits, and never a list. The number of rounds grows
    with the logarithm of the longest path. Each round is a written table.
    """
    edges, sign = _written(_pairs(links.filter(F.col(a) != F.col(b)), a, b).distinct())
    seen = None
    while sign["n"] and sign != seen:
        seen = sign
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = _pairs(both.join(least, "u").filter(F.col("v") > F.col("u")).select("v", "m"), "v", "m")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select("u", "m").union(joined.filter(F.col("v") != F.col("m")).select("v", "m"))
        edges, sign = _written(_pairs(small, "u", "m").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", F.col("v").alias("label")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges as a table, and figures that tell whether a round changed them."""
    return saved_with(edges, "edges", F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))


def _pairs(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links as (u, v) with u > v."""
    return links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
