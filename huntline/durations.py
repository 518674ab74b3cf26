"""Duration texts such as ``500ms``, ``2m`` or ``1m30s``."""

from __future__ import annotations

import re
from datetime import timedelta
from fractions import Fraction

# Duration units in microseconds.
UNITS = {"ns": Fraction(1, 1000), "us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000,
         "d": 86_400_000_000, "w": 604_800_000_000}


def micros(value: str | int | timedelta) -> int:
    """Length in microseconds; numbers are taken as microseconds."""
    if isinstance(value, timedelta):
        return round(value.total_seconds() * 1_000_000)
    if isinstance(value, int):
        return value
    parts = re.findall(r"(\d+)(ns|us|ms|s|m|h|d|w)", value.replace(" ", ""))
    if not parts or "".join(n + u for n, u in parts) != value.replace(" ", ""):
        raise ValueError(f"not a duration: {value!r}")
    return int(sum(int(n) * UNITS[u] for n, u in parts))
