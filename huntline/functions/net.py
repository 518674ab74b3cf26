"""Address functions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logic import or_, true_or_false

_V4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
_DEC = "decimal(38,0)"


def ipv4_number(col: Column) -> Column:
    """Dotted text as a number; NULL for anything else."""
    parts = [F.split_part(col, F.lit("."), F.lit(i)).cast("bigint") for i in range(1, 5)]
    value = parts[0] * 16777216 + parts[1] * 65536 + parts[2] * 256 + parts[3]
    ok = F.greatest(*parts) <= 255
    return F.when(col.rlike(_V4), F.when(ok, value))


def ipv6_groups(col: Column) -> Column:
    """The eight 16-bit groups of an IPv6 text as an array of numbers."""
    bare = F.lower(F.split_part(col, F.lit("%"), F.lit(1)))
    head = F.split_part(bare, F.lit("::"), F.lit(1))
    tail = F.when(bare.contains("::"), F.split_part(bare, F.lit("::"), F.lit(2))).otherwise(F.lit(""))
    def groups(text: Column) -> Column:
        return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(text, ":"))
    left, right = groups(head), groups(tail)
    missing = F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))
    full = F.when(bare.contains("::"), F.concat(left, F.array_repeat(F.lit("0"), missing), right)).otherwise(left)
    numbers = F.transform(full, lambda g: F.conv(g, 16, 10).cast("bigint"))
    return F.when(col.contains(":") & (F.size(numbers) == 8) & F.forall(numbers, lambda g: g <= 65535), numbers)


def normal_ip(ip: str) -> str:
    try:
        address = ipaddress.ip_address(ip)
    except ValueError:
        return ip
    mapped = getattr(address, "ipv4_mapped", None)
    return str(mapped) if mapped else ":".join(str(int(g, 16)) for g in address.exploded.split(":")) \
        if address.version == 6 else str(address)


def normal_ip_column(col: Column) -> Column:
    """Spelling-independent key: IPv4 text as is, IPv6 as eight decimal groups."""
    return F.when(col.contains(":"), F.array_join(ipv6_groups(col), ":")).otherwise(col)


def cidr_contains(col: Column, *cidrs: str) -> Column:
    """Any of the blocks holds the address; a malformed block is skipped."""
    tests = []
    for cidr in cidrs:
        try:
            if "/" not in cidr:
                continue
            block = ipaddress.ip_network(cidr, strict=False)
        except ValueError:
            continue
        if block.version == 4:
            low, high = int(block.network_address), int(block.broadcast_address)
            tests.append(ipv4_number(col).between(low, high))
        else:
            groups = ipv6_groups(col)
            low = [int(g, 16) for g in block.network_address.exploded.split(":")]
            high = [int(g, 16) for g in block.broadcast_address.exploded.split(":")]
            # Only the group the prefix ends in is a real range; those before are fixed.
            tests.append(true_or_false(groups.isNotNull()) & _all(
                [groups[i].between(low[i], high[i]) for i in range(8) if (low[i], high[i]) != (0, 65535)]))
    return true_or_false(or_(*tests))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out
