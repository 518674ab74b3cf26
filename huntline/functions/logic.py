"""Two-valued logic over typed zeros."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_LITERALS = {
    "string": "''", "long": "cast(0 as bigint)", "int": "0", "double": "cast(0.0 as double)", "bool": "false",
    "address": "cast(0 as decimal(20,0))", "strings": "cast(array() as array<string>)",
    "longs": "cast(array() as array<bigint>)", "map": "cast(map() as map<string,string>)",
}


def zero(kind: str) -> Column:
    """What a missing field of this kind evaluates to; times stay NULL and compare as false."""
    return F.expr(ZERO_LITERALS[kind]) if kind in ZERO_LITERALS else F.lit(None).cast("timestamp")


def or_zero(col: Column, kind: str) -> Column:
    return F.coalesce(col, zero(kind)) if kind in ZERO_LITERALS else col


def never_null(col: Column) -> Column:
    """Mark a Boolean column that cannot be NULL, so that it is not wrapped again (a wrapper would block pushdown)."""
    col.__dict__["_never_null"] = True
    return col


def true_or_false(col: Column) -> Column:
    return col if col.__dict__.get("_never_null") else never_null(F.coalesce(col, F.lit(False)))


def present_and(col: Column, test: Column) -> Column:
    """A test of a column against literals, false when the column is missing; both parts can be pushed to a scan."""
    return never_null(test & col.isNotNull())


def and_(*cols: Column) -> Column:
    return never_null(reduce(lambda a, b: a & b, [true_or_false(c) for c in cols], F.lit(True)) if cols else F.lit(True))


def or_(*cols: Column) -> Column:
    return never_null(reduce(lambda a, b: a | b, [true_or_false(c) for c in cols]) if cols else F.lit(False))


def not_(col: Column) -> Column:
    return never_null(~true_or_false(col))


def keep_where(*cols: Column) -> Column:
    """Disjunction for a filter, where NULL drops the row anyway."""
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def as_list(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]


def is_array(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.ArrayType)
