"""From raw documents to shuffled shards of a training mix: five stages, each one operator of huntline.llm.

Every stage but the last returns the columns of documents, so stages can be
written, read again and run on their own.

Defined results, by stage: a null, empty or blank text fails the quality rules
and is gone after the first stage; run on its own, near-duplicates treats such
texts as equal texts (one stays), decontamination keeps them, mixing gives them
no copies (they have no words), sharding places them like any other row. Rows
with one key are rows of their own for quality, decontamination, mixing and
sharding; repeated texts are near-duplicates of each other, of which one row
stays. A null key or source is a value like any other. Very long texts are
worked on whole. An empty table gives an empty result. Extra columns stay as
they are, whatever their names; the last stage adds shard and slot, and leaves out
earlier columns named shard, slot or bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huntline.llm import decontamination, mixing, quality_rules, sharding, simhash
from huntline.llm.columns import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark passages."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order, with shard and slot."""
    return sharding.shard(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", contamination), ("mixing", mixture), ("sharding", shards)]

#: Fingerprints and seeded hashes have no counterpart in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a written table, so a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
