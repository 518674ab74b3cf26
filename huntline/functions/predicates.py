"""Predicates of the filter vocabulary, each a Boolean column that is never NULL.

Text operators come in a scalar and an array form (``any_of=True`` treats the
left side as an array and asks for any element). A list on the right means
"any of".
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .logic import and_, as_column, as_list, keep_where, not_, or_, present_and, true_or_false

__all__ = [
    "and_", "or_", "not_", "eq", "ne", "lt", "le", "gt", "ge", "ieq", "in_", "iin", "contains", "icontains",
    "startswith", "istartswith", "endswith", "iendswith", "matches", "imatches", "fuzzy", "ifuzzy", "fuzzynorm",
    "ifuzzynorm", "intersects", "iintersects", "any_gt", "any_ge", "ip_eq", "ip_in", "flags", "flags_text",
    "wildcard_column", "wildcard_regex", "excluded",
]


def _number(value) -> Column:
    """Numeric operand; text that is no number becomes NULL, which compares as false."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.expr(f"try_cast({sql_text(value)} as double)")
    return F.lit(value)


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def eq(col: Column, rhs) -> Column:
    return _compare(col, rhs, lambda a, b: a == b)


def ne(col: Column, rhs) -> Column:
    return true_or_false(col != as_column(rhs))


def num_eq(col: Column, rhs) -> Column:
    return true_or_false(col == _number(rhs))


def num_ne(col: Column, rhs) -> Column:
    """False, not true, when the right side is no number."""
    return true_or_false(col != _number(rhs))


def _compare(col: Column, rhs, test) -> Column:
    if isinstance(rhs, (Column, type(None))):
        return true_or_false(test(col, as_column(rhs)))
    return present_and(col, test(col, F.lit(rhs)))


def _order(col: Column, rhs, test) -> Column:
    return true_or_false(test(col, _number(rhs))) if isinstance(rhs, str) else _compare(col, rhs, test)


def lt(col: Column, rhs) -> Column:
    return _order(col, rhs, lambda a, b: a < b)


def le(col: Column, rhs) -> Column:
    return _order(col, rhs, lambda a, b: a <= b)


def gt(col: Column, rhs) -> Column:
    return _order(col, rhs, lambda a, b: a > b)


def ge(col: Column, rhs) -> Column:
    return _order(col, rhs, lambda a, b: a >= b)


def ieq(col: Column, rhs) -> Column:
    return true_or_false(F.lower(col) == F.lower(as_column(rhs)))


def in_(col: Column, values, any_of: bool = False) -> Column:
    values = as_list(values)
    if any_of:
        return true_or_false(F.arrays_overlap(col, F.array(*[as_column(v) for v in values])))
    return present_and(col, col.isin(values))


def iin(col: Column, values, any_of: bool = False) -> Column:
    lowered = [v.lower() for v in as_list(values)]
    if any_of:
        return true_or_false(F.arrays_overlap(F.transform(col, F.lower), F.array(*[F.lit(v) for v in lowered])))
    return true_or_false(F.lower(col).isin(lowered))


def _any(col: Column, rhs, test, fold: bool, any_of: bool) -> Column:
    operands = as_list(rhs)
    if fold:
        operands = [F.lower(o) if isinstance(o, Column) else o.lower() for o in operands]

    def one(item: Column) -> Column:
        text = F.lower(item) if fold else item
        tests = [test(text, o) for o in operands]
        if any(isinstance(o, Column) for o in operands):
            return or_(*tests)
        return present_and(item, keep_where(*tests))

    return true_or_false(F.exists(col, one)) if any_of else one(col)


def contains(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, lambda c, o: c.contains(o), False, any_of)


def icontains(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, lambda c, o: c.contains(o), True, any_of)


def startswith(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, lambda c, o: c.startswith(o), False, any_of)


def istartswith(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, lambda c, o: c.startswith(o), True, any_of)


def endswith(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, lambda c, o: c.endswith(o), False, any_of)


def iendswith(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, lambda c, o: c.endswith(o), True, any_of)


def java_quote(text: str) -> str:
    """Text as a literal inside a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&#~ ])", r"\\\1", text)


def wildcard_regex(pattern: str) -> str:
    """Anchored expression for ``*`` (any run) and ``?`` (one character)."""
    parts = {"*": ".*", "?": "."}
    return "(?s)^" + "".join(parts.get(ch) or java_quote(ch) for ch in re.sub(r"\*+", "*", pattern)) + "$"


def wildcard_column(col: Column, pattern: str) -> Column:
    """Wildcard test; prefix, suffix and substring shapes avoid the regular expression."""
    body = re.sub(r"\*+", "*", pattern)
    inner = body.strip("*")
    if "?" in body or "*" in inner:
        return col.rlike(wildcard_regex(body))
    if body == "*":
        return col.isNotNull()
    if body == inner:
        return col == inner
    if body == inner + "*":
        return col.startswith(inner)
    if body == "*" + inner:
        return col.endswith(inner)
    return col.contains(inner)


def matches(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, wildcard_column, False, any_of)


def imatches(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, wildcard_column, True, any_of)


def _subsequence(col: Column, pattern: str) -> Column:
    """Characters in order: each is taken at its first chance, so one linear pass decides."""
    if not pattern:
        return F.lit(True)
    return col.rlike("^" + "".join(f"[^{java_quote(ch)}]*+{java_quote(ch)}" for ch in pattern))


def fuzzy(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, _subsequence, False, any_of)


def ifuzzy(col: Column, rhs, any_of: bool = False) -> Column:
    return _any(col, rhs, _subsequence, True, any_of)


def strip_marks(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))


def _accented() -> tuple[str, str]:
    """Latin letters whose decomposition is one base letter plus marks."""
    pairs = [(chr(code), strip_marks(chr(code))) for code in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_marks(col: Column) -> Column:
    return F.translate(col, *_accented())


def fuzzynorm(col: Column, rhs, any_of: bool = False) -> Column:
    col = F.transform(col, without_marks) if any_of else without_marks(col)
    return fuzzy(col, [strip_marks(r) for r in as_list(rhs)], any_of)


def ifuzzynorm(col: Column, rhs, any_of: bool = False) -> Column:
    col = F.transform(col, without_marks) if any_of else without_marks(col)
    return ifuzzy(col, [strip_marks(r) for r in as_list(rhs)], any_of)


def intersects(arr: Column, values) -> Column:
    """All values are present in the array."""
    rhs = F.array(*[as_column(v) for v in as_list(values)])
    return true_or_false(F.size(F.array_except(rhs, arr)) == 0)


def common(arr: Column, values, fold: bool = False) -> Column:
    """The array's members that are among the values, each once, sorted; ``fold`` takes no notice of case."""
    wanted = [v.lower() for v in values] if fold else list(values)
    hits = F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda x: (F.lower(x) if fold else x).isin(wanted))
    return F.sort_array(F.array_distinct(hits))


def iintersects(arr: Column, values) -> Column:
    return intersects(F.transform(arr, F.lower), [v.lower() for v in as_list(values)])


def any_gt(arr: Column, n) -> Column:
    return true_or_false(F.exists(arr, lambda x: x > n))


def any_ge(arr: Column, n) -> Column:
    return true_or_false(F.exists(arr, lambda x: x >= n))


def ip_eq(col: Column, ip: str) -> Column:
    from .net import normal_ip, normal_ip_column
    return true_or_false(normal_ip_column(col) == normal_ip(ip))


def ip_in(col: Column, ips) -> Column:
    from .net import normal_ip, normal_ip_column
    return true_or_false(normal_ip_column(col).isin([normal_ip(i) for i in as_list(ips)]))


def flags(col: Column, table: list[tuple[str, int]]) -> Column:
    """Bitmask to the array of flag names, first entry first, each bit used once."""
    literal = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("bigint").alias("bits")) for n, v in table])
    start = F.struct(col.cast("bigint").alias("left"), F.expr("cast(array() as array<string>)").alias("names"))

    def step(acc: Column, flag: Column) -> Column:
        bits = flag["bits"]
        hit = F.when(bits == 0, acc["left"] == 0).otherwise(acc["left"].bitwiseAND(bits) == bits)
        return F.struct(
            F.when(hit, acc["left"].bitwiseAND(F.bitwise_not(bits))).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.array_append(acc["names"], flag["name"])).otherwise(acc["names"]).alias("names"))

    return F.coalesce(F.aggregate(literal, start, step, lambda acc: acc["names"]),
                      F.expr("cast(array() as array<string>)"))


def flags_text(col: Column, table: list[tuple[str, int]]) -> Column:
    return F.array_join(flags(col, table), "|")


def excluded(col: Column, patterns) -> Column:
    """Matches any pattern of a case-insensitive exclusion list."""
    return imatches(col, list(patterns))
