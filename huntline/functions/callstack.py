"""Call stack functions over ``ARRAY<STRUCT<pid, addr, offset, symbol, module, module_addr>>``.

Index 0 is the outermost user frame, the last element the innermost frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logic import true_or_false
from .paths import base

UNBACKED = "unbacked"
# Bounds of the kernel address range (upper one exclusive).
SYSTEM_RANGE = (0xFFFFF80000000000, 0xFFFFFFFFFFFFFFFF)
# Modules every user call passes through on its way to the kernel.
LOADER_MODULES = ["ntdll.dll", "kernel32.dll", "kernelbase.dll"]


def in_system_range(addr: Column) -> Column:
    low, high = (F.lit(str(v)).cast("decimal(20,0)") for v in SYSTEM_RANGE)
    return true_or_false((addr >= low) & (addr < high))


def is_unbacked_frame(frame: Column) -> Column:
    return true_or_false((frame["module"] == UNBACKED) | (frame["module"] == ""))


def hex_address(addr: Column) -> Column:
    """Lower-case hex of an unsigned 64-bit number."""
    return F.lower(F.conv(addr.cast("string"), 10, 16))


def depth(stack: Column) -> Column:
    return F.size(F.coalesce(stack, F.expr("array()")))


def modules(stack: Column) -> Column:
    return F.transform(stack, lambda f: f["module"])


def symbols(stack: Column) -> Column:
    return F.transform(stack, lambda f: F.concat(base(f["module"]), F.lit("!"), f["symbol"]))


def addresses(stack: Column) -> Column:
    return F.transform(stack, lambda f: hex_address(f["addr"]))


def at(items: Column, n: int) -> Column:
    return F.coalesce(F.get(items, F.lit(n)), F.lit(""))


def summary(stack: Column, mode: str = "user") -> Column:
    """Base module names from the innermost frame outwards, runs collapsed, joined by a bar."""
    inward = F.reverse(stack)
    if mode == "user":
        frames = F.filter(inward, lambda f: ~in_system_range(f["addr"]))
    else:
        first_user = F.array_position(F.transform(inward, lambda f: in_system_range(f["addr"])), False)
        frames = F.when(first_user > 0, F.slice(inward, F.lit(1), (first_user - 1).cast("int"))).otherwise(inward)
    names = F.transform(frames, lambda f: F.when(is_unbacked_frame(f), F.lit(UNBACKED)).otherwise(base(f["module"])))
    kept = F.filter(names, lambda n, i: (i == 0) | (F.get(names, i - 1) != n))
    return F.array_join(kept, "|")


def detail(stack: Column) -> Column:
    """``0xaddr module!symbol+0xoffset`` per frame from the innermost outwards."""
    def one(f: Column) -> Column:
        module = F.when(in_system_range(f["addr"]) & (f["module"] == UNBACKED), F.lit("?")).otherwise(f["module"])
        symbol = F.when((f["symbol"] != "") & (f["symbol"] != "?"), f["symbol"]).otherwise(F.lit("?"))
        offset = F.when(f["offset"] != 0, F.concat(F.lit("+0x"), F.lower(F.hex(f["offset"])))).otherwise(F.lit(""))
        return F.concat(F.lit("0x"), hex_address(f["addr"]), F.lit(" "), module, F.lit("!"), symbol, offset)
    return F.array_join(F.transform(F.reverse(stack), one), "|")


def final_user_frame(stack: Column) -> Column:
    """Last user frame before the native loader modules; the outermost frame when none qualifies."""
    size = F.size(stack)

    def candidate(f: Column, i: Column) -> Column:
        module = F.lower(base(f["module"]))
        return (i > 0) & ~in_system_range(f["addr"]) & ~module.isin(LOADER_MODULES)

    spots = F.filter(F.transform(stack, lambda f, i: F.when(candidate(f, i), i)), lambda i: i.isNotNull())
    at_index = F.coalesce(F.array_max(spots), F.lit(0))
    return F.when(at_index < size - 1, F.get(stack, at_index))


def final_userspace_frame(stack: Column) -> Column:
    """Innermost frame outside the kernel range; the outermost frame is not considered."""
    frames = F.filter(stack, lambda f, i: (i > 0) & ~in_system_range(f["addr"]))
    return F.try_element_at(frames, F.lit(-1))


def final_kernel_frame(stack: Column) -> Column:
    return F.try_element_at(stack, F.lit(-1))


def is_unbacked(stack: Column) -> Column:
    return true_or_false(F.exists(stack, lambda f: ~in_system_range(f["addr"]) & is_unbacked_frame(f)))


def contains_symbol(stack: Column, name: str) -> Column:
    return true_or_false(F.exists(stack, lambda f: f["symbol"] == name))


def provenance(frame: Column) -> Column:
    """Origin of a frame: kernel, loader modules (system) or anything else (user)."""
    module = F.lower(base(frame["module"]))
    return (F.when(in_system_range(frame["addr"]), F.lit("kernel"))
            .when(module.isin(LOADER_MODULES), F.lit("system"))
            .otherwise(F.lit("user")))
