"""Registered queries and their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = ["scans", "fields", "predicates", "scalars", "joins", "aggregates", "sequences", "rules", "streams"]


def load() -> tuple[dict, dict]:
    """All queries and all SQL texts by name."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    from .registry import ORACLES, QUERIES
    return QUERIES, ORACLES
