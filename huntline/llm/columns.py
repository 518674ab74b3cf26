"""Column helpers shared by the operators of this folder, and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, whatever body does with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the runs of characters outside ASCII white space; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Only a session in one local process may go without the setting (as in
    tests); it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="huntline-llm-")
    return f"{root.rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage, outlives executors."""
    return saved_with(df, what)[0]


def saved_with(df: DataFrame, what: str, *figures: Column) -> tuple[DataFrame, dict]:
    """Like saved, with figures (named aggregates) that are taken while the rows are written."""
    folder, seen = shared_folder(df.sparkSession, what), Observation(what)
    (df.observe(seen, *figures) if figures else df).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), seen.get if figures else {}


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name in taken:
        name += "_"
    return name
