"""Event transformers: parameter edits and tags, applied in the given order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import params as fn


def remove_params(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumn("params", fn.remove(F.col("params"), names))


def rename_params(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumn("params", fn.rename(F.col("params"), pairs))


def replace_params(df: DataFrame, triples: list[tuple[str, str, str]]) -> DataFrame:
    return df.withColumn("params", fn.replace(F.col("params"), triples))


def trim_params(df: DataFrame, prefixes=(), suffixes=()) -> DataFrame:
    return df.withColumn("params", fn.trim(F.col("params"), list(prefixes), list(suffixes)))


def add_tags(df: DataFrame, tags: list[tuple[str, str]]) -> DataFrame:
    return df.withColumn("meta", fn.add_tags(F.col("meta"), tags))


STEPS = {"remove": remove_params, "rename": rename_params, "replace": replace_params, "trim": trim_params,
         "tags": add_tags}


def transform_events(df: DataFrame, steps: list[tuple]) -> DataFrame:
    """``[("remove", names), ("rename", pairs), …]`` in the configured order."""
    for name, *args in steps:
        df = STEPS[name](df, *args)
    return df
