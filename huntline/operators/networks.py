"""Addresses matched with tables of networks: overlapping blocks cut into disjoint segments, one as-of lookup for each address.

Blocks of one family are nested or disjoint. Where a block begins, it is the
most specific one; where it ends, the smallest block around it that goes on
takes over. So each block gives two points, and an address belongs to the last
point at or below it. What surrounds a block is found by equi-joins on its own
leading bits, one for each shorter length, never by comparing blocks in pairs.

IPv6 addresses are two halves of 64 bits: blocks of up to 64 bits are ranges of
the upper half, longer ones are ranges of the lower half under an equal upper
half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ipv4_number, ipv6_groups
from ..session import durable
from .asof import Source, lookups

TOP = (1 << 63) - 1
BOTTOM = -(1 << 63)


def _half(groups: Column, first: int) -> Column:
    """Four groups as a signed number whose order is that of the unsigned one."""
    g = [groups[first + i] for i in range(4)]
    return (g[0] - 32768) * (1 << 48) + g[1] * (1 << 32) + g[2] * (1 << 16) + g[3]


def _aligned(number: Column, bits: Column) -> Column:
    """The number with all but its leading ``bits`` of 64 cleared."""
    free = F.lit(64) - bits
    return F.when(bits == 0, F.lit(BOTTOM)).otherwise(F.call_function("shiftleft", F.call_function("shiftright", number, free), free))


def blocks(networks: DataFrame, network: str, name: str) -> DataFrame:
    """(space, bits, start, end, name): well-formed blocks; of equal ones the smallest name stays."""
    address, length = F.split_part(network, F.lit("/"), F.lit(1)), F.split_part(network, F.lit("/"), F.lit(2)).try_cast("int")
    rows = networks.where(F.col(network).contains("/")).select(address.alias("a"), length.alias("p"), F.col(name).alias("name"))
    rows = rows.select("name", "p", ipv4_number(F.col("a")).alias("n"), ipv6_groups(F.col("a")).alias("g"))
    four = rows.where("n is not null and p between 0 and 32").select(F.lit("4").alias("space"), (F.col("p") + 32).alias("bits"), F.col("n").alias("at"), "name")
    wide = rows.where("g is not null and p between 0 and 64").select(F.lit("6").alias("space"), F.col("p").alias("bits"), _half(F.col("g"), 0).alias("at"), "name")
    narrow = rows.where("g is not null and p between 65 and 128").select(_under(F.col("g")).alias("space"), (F.col("p") - 64).alias("bits"), _half(F.col("g"), 4).alias("at"), "name")
    placed = four.unionByName(wide).unionByName(narrow).withColumn("start", _aligned(F.col("at"), F.col("bits")))
    distinct = placed.groupBy("space", "bits", "start").agg(F.min("name").alias("name"))
    rest = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.col("bits"))
    return distinct.withColumn("end", F.when(F.col("bits") == 0, F.lit(TOP)).when(F.col("bits") == 64, F.col("start")).otherwise(F.col("start").bitwiseOR(rest)))


def _under(groups: Column) -> Column:
    return F.concat(F.lit("6:"), _half(groups, 0).cast("string"))


def segments(table: DataFrame) -> DataFrame:
    """(space, at, name): from ``at`` on, up to the next point of the space, ``name`` is the most specific block (NULL: none)."""
    shorter = table.where("bits > 0").select("space", "start", "end", F.explode(F.sequence(F.lit(0), F.col("bits") - 1)).alias("bits"))
    asked = shorter.select("space", "bits", _aligned(F.col("start"), F.col("bits")).alias("start"), F.col("start").alias("own"), F.col("end").alias("own_end"))
    around = asked.join(table.select("space", "bits", "start", F.col("end").alias("outer"), F.col("name").alias("heir")), ["space", "bits", "start"])
    heirs = around.where("outer > own_end").groupBy("space", "own", "own_end").agg(F.max_by("heir", "bits").alias("heir"))
    ends = table.where(F.col("end") < TOP).join(heirs.withColumnsRenamed({"own": "start", "own_end": "end"}), ["space", "start", "end"], "left")
    points = table.select("space", F.col("start").alias("at"), "bits", "name").unionByName(ends.select("space", (F.col("end") + 1).alias("at"), F.lit(-1).alias("bits"), F.col("heir").alias("name")))
    return points.groupBy("space", "at").agg(F.max_by(F.struct("name"), "bits").alias("s")).select("space", "at", "s.name")


def match_networks(rows: DataFrame, address: str, networks: DataFrame, network: str = "network", name: str = "name", out: str = "network_name",
                   rows_per_slice: int | None = None) -> DataFrame:
    """``out``: name of the most specific block that holds the address, NULL for none and for malformed addresses. Malformed blocks are skipped."""
    # Both are used several times, and are far smaller than the rows.
    table = durable(segments(durable(blocks(networks, network, name))))
    options = {} if rows_per_slice is None else {"rows_per_slice": rows_per_slice}
    four, groups = ipv4_number(F.col(address)), ipv6_groups(F.col(address))
    known = rows.withColumns({"_four": four, "_six": groups})
    upper = F.coalesce("_four", _half(F.col("_six"), 0))
    space = F.when(F.col("_four").isNotNull(), F.lit("4")).when(F.col("_six").isNotNull(), F.lit("6"))
    known = known.withColumns({"_space": space, "_at": upper, "_under": F.when(F.col("_six").isNotNull(), _under(F.col("_six"))), "_low": _half(F.col("_six"), 4)}).drop("_four", "_six")
    table = table.withColumnsRenamed({"name": "_name"})
    wide = lookups(known, F.col("_at"), {"_wide": ["_space"]}, {"net": Source(table, ["space"], F.col("at"), ["_name"])}, **options)
    narrow = lookups(wide, F.col("_low"), {"_narrow": ["_under"]}, {"net": Source(table.where(F.col("space").startswith("6:")), ["space"], F.col("at"), ["_name"])}, **options)
    return narrow.select(*rows.columns, F.coalesce("_narrow_net._name", "_wide_net._name").alias(out))
