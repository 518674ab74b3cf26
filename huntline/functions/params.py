"""Functions over the ``MAP<STRING, STRING>`` of event parameters."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ltrim, rtrim


def remove(params: Column, names: list[str]) -> Column:
    return F.map_filter(params, lambda k, _: ~k.isin(list(names)))


def rename(params: Column, pairs: list[tuple[str, str]]) -> Column:
    """Old to new in the given order; the new name overwrites, an absent old one is ignored."""
    for old, new in pairs:
        if old == new:
            continue
        value = params[old]
        rest = remove(params, [old, new])
        params = F.when(F.map_contains_key(params, F.lit(old)),
                        F.map_concat(rest, F.create_map(F.lit(new), value))).otherwise(params)
    return params


def replace(params: Column, triples: list[tuple[str, str, str]]) -> Column:
    """(param, old, new): literal replacement inside one parameter's value."""
    def value_of(k: Column, v: Column) -> Column:
        for name, old, new in triples:
            v = F.when(k == name, F.replace(v, F.lit(old), F.lit(new))).otherwise(v)
        return v
    return F.transform_values(params, value_of)


def trim(params: Column, prefixes: list[tuple[str, str]] = (), suffixes: list[tuple[str, str]] = ()) -> Column:
    """(param, text): cut exact prefixes first, then exact suffixes."""
    def value_of(k: Column, v: Column) -> Column:
        for name, prefix in prefixes:
            v = F.when(k == name, ltrim(v, prefix)).otherwise(v)
        for name, suffix in suffixes:
            v = F.when(k == name, rtrim(v, suffix)).otherwise(v)
        return v
    return F.transform_values(params, value_of)


def add_tags(meta: Column, tags: list[tuple[str, str]]) -> Column:
    """Literal or ``%ENV%`` values, resolved on the driver; empty values are left out."""
    resolved = {}
    for key, value in tags:
        if len(value) > 2 and value.startswith("%") and value.endswith("%"):
            value = os.environ.get(value[1:-1], "")
        if value:
            resolved[key] = value
    if not resolved:
        return meta
    return merge(meta, F.create_map(*[F.lit(x) for kv in resolved.items() for x in kv]), list(resolved))


def merge(base: Column, extra: Column, keys: list[str]) -> Column:
    """Right map wins on the listed keys."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~k.isin(keys)), extra)


def params_text(params: Column, style: str = "snake", delimiter: str = "➜ ") -> Column:
    """``k=v, k=v`` in key order; snake, dot or Pascal spelling of the keys."""
    def spell(key: Column) -> Column:
        if style == "dot":
            return F.replace(key, F.lit("_"), F.lit("."))
        if style == "pascal":
            return F.replace(F.initcap(F.replace(key, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
        return key
    entries = F.sort_array(F.map_entries(params))
    return F.array_join(F.transform(entries, lambda e: F.concat(spell(e["key"]), F.lit(delimiter), e["value"])), ", ")


def env_value(envs: Column, name: str) -> Column:
    """Exact variable, else the one with the smallest name that starts with ``name``."""
    candidates = F.filter(F.sort_array(F.map_entries(envs)), lambda e: e["key"].startswith(name))
    return F.coalesce(envs[name], F.get(candidates, F.lit(0))["value"], F.lit(""))


def env_list(envs: Column) -> Column:
    return F.transform(F.sort_array(F.map_entries(envs)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
