"""Scalar functions of the rule vocabulary as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logic import as_column, or_, true_or_false
from .net import cidr_contains
from .paths import base, cmdline_exe, cmdline_normalize, cmdline_split, dir_, ext, file_type, is_abs, registry_key, volume
from .predicates import java_quote, wildcard_column

__all__ = [
    "cidr_contains", "md5", "concat", "ltrim", "rtrim", "lower", "upper", "replace", "split", "length", "indexof",
    "substr", "entropy", "regex", "base", "dir_", "ext", "is_abs", "volume", "count", "foreach", "cmdline_split",
    "cmdline_normalize", "cmdline_exe", "registry_key", "file_type", "protection_mask", "view_protection",
    "strip_markdown", "is_minidump",
]

lower, upper, md5 = F.lower, F.upper, F.md5


def concat(first, second, *more) -> Column:
    return F.concat(*[as_column(v).cast("string") for v in (first, second, *more)])


def ltrim(text: Column, prefix: str) -> Column:
    """Cut one exact prefix."""
    return F.when(text.startswith(prefix), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def rtrim(text: Column, suffix: str) -> Column:
    """Cut one exact suffix."""
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def replace(text: Column, *pairs: str) -> Column:
    if not pairs or len(pairs) % 2:
        raise ValueError("replacements come in complete old, new pairs")
    for old, new in zip(pairs[::2], pairs[1::2]):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def split(text: Column, sep: str) -> Column:
    return F.split(text, java_quote(sep), -1)


def length(value: Column, array: bool = False) -> Column:
    return F.size(value) if array else F.char_length(value)


def _bytes_before(text: Column, position: Column) -> Column:
    """Character position (1-based, 0 = absent) as a 0-based byte index."""
    return F.when(position > 0, F.octet_length(F.substring(text, F.lit(1), position - 1))).otherwise(F.lit(-1))


def indexof(text: Column, sub: str, order: str = "first") -> Column:
    """Byte index of ``sub``; the "any" orders look for any of its characters."""
    def last_of(needle: str) -> Column:
        found = F.instr(F.reverse(text), needle[::-1])
        return F.when(found > 0, F.char_length(text) - found - len(needle) + 2).otherwise(F.lit(0))

    if order == "first":
        position = F.instr(text, sub)
    elif order == "last":
        position = last_of(sub)
    elif order == "any":
        chars = sorted(set(sub))
        spots = [F.nullif(F.instr(text, ch), F.lit(0)) for ch in chars]
        position = F.coalesce(F.least(*spots) if len(spots) > 1 else spots[0], F.lit(0))
    elif order == "lastany":
        spots = [last_of(ch) for ch in sorted(set(sub))]
        position = F.greatest(*spots) if len(spots) > 1 else spots[0]
    else:
        raise ValueError(f"unknown index order {order!r}")
    return _bytes_before(text, position)


def substr(text: Column, start, end=None) -> Column:
    """Byte slice when the bounds are valid (``end`` strictly inside), else the whole text."""
    start = as_column(start)
    size = F.octet_length(text)
    raw = F.encode(text, "UTF-8")
    if end is None:
        ok, width = (start >= 0) & (start < size), size - start
    else:
        end = as_column(end)
        ok, width = (start >= 0) & (end >= start) & (end < size), end - start
    ascii_only = size == F.char_length(text)
    part = F.when(ascii_only, F.substring(text, start + 1, width)).otherwise(
        F.decode(F.substring(raw, start + 1, width), "UTF-8"))
    return F.when(ok, part).otherwise(text)


def entropy(text: Column) -> Column:
    """Rounded-up Shannon entropy times the byte length; shares are runes per byte.

    Each distinct character is counted by how much the text shrinks without it,
    which stays inside native string code for the whole text.
    """
    size = F.octet_length(text)
    runes = F.array_distinct(F.filter(F.split(text, ""), lambda ch: ch != ""))

    def term(acc: Column, ch: Column) -> Column:
        count = (size - F.octet_length(F.replace(text, ch, F.lit("")))) / F.octet_length(ch)
        share = count / size
        return acc + share * F.log2(share)

    total = F.aggregate(runes, F.lit(0.0).cast("double"), term)
    return F.when(size == 0, F.lit(0).cast("bigint")).otherwise(F.ceil(-F.round(total, 12)) * size)


def regex(text: Column, *patterns: str) -> Column:
    """Any pattern is found anywhere; malformed patterns are skipped."""
    usable = []
    for pattern in patterns:
        try:
            re.compile(pattern)
            usable.append(pattern)
        except re.error:
            continue
    return or_(*[text.rlike(p) for p in usable])


def count(value: Column, pattern: str, ignore_case: bool = True, array: bool = False) -> Column:
    """Words of a text, or elements of an array, that match the wildcard."""
    words = value if array else F.filter(F.split(value, r"\s+"), lambda w: w != "")
    if ignore_case:
        pattern = pattern.lower()
        return F.size(F.filter(words, lambda w: wildcard_column(F.lower(w), pattern)))
    return F.size(F.filter(words, lambda w: wildcard_column(w, pattern)))


def foreach(items: Column, predicate) -> Column:
    """Some element satisfies the predicate; outer columns are plain closures."""
    return true_or_false(F.exists(items, lambda item: true_or_false(predicate(item))))


# Page protection codes and their masks.
PAGE_PROTECTION = {0x02: "R", 0x04: "RW", 0x20: "RX", 0x40: "RWX", 0x80: "RWXC", 0x10: "X", 0x08: "WC", 0x01: "NA",
                   0x400: "WCB", 0x100: "PG", 0x104: "PG", 0x200: "NC", 0: "-"}
# Section view protections, widest first so that each bit is named once.
VIEW_PROTECTION = [("WXC", 0x70000), ("RWX", 0x60000), ("WC", 0x50000), ("RX", 0x30000), ("WCB", 0x90000),
                   ("NC", 0x80000), ("RW", 0x40000), ("X", 0x20000), ("R", 0x10000)]


def protection_mask(code: Column) -> Column:
    out = None
    for value, mask in PAGE_PROTECTION.items():
        out = F.when(code == value, F.lit(mask)) if out is None else out.when(code == value, F.lit(mask))
    return out.otherwise(F.lit("?"))


def view_protection(code: Column) -> Column:
    from .predicates import flags_text
    return flags_text(code, VIEW_PROTECTION)


# Markdown constructs and what is left of each, applied in this order.
MARKDOWN_RULES = [
    (r"(?m)^([\s\t]*)([\*\-\+]|\d\.)\s+", "$1"),
    (r"\n={2,}", "\n"), (r"~~", ""), (r"`{3}.*\n", ""),
    (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"),
    (r"<(.*?)>", "$1"), (r"^[=\-]{2,}\s*$", ""),
    (r"\[\^.+?\](\: .*?$)?", ""), (r"\s{0,2}\[.*?\]: .*?$", ""),
    (r"!\[(.*?)\]\s?[\[\(].*?[\]\)]", ""), (r"\[(.*?)\][\[\(].*?[\]\)]", "$1"),
    (r">\s*", "  "),
    (r"(?m)^#{1,6}\s*([^#]+)\s*(#{1,6})?$", "$1"),
    (r"^-{3,}\s*$", ""), (r"`(.+?)`", "$1"), (r"\n{2,}", "\n\n"),
]


def strip_markdown(text: Column) -> Column:
    for pattern, left in MARKDOWN_RULES:
        text = F.regexp_replace(text, pattern, left)
    return text


def is_minidump(content: Column) -> Column:
    """Binary content starts with the minidump signature."""
    return true_or_false(F.hex(F.substring(content, 1, 4)) == "4D444D50")
