"""Sharding by a two-pass external shuffle.

First pass: records are scattered uniformly into buckets that fit a task's
memory, by seeded hashes. Second pass: each bucket is put into random order by
a Fisher-Yates shuffle (Spark's ``shuffle`` of an array is one). The buckets,
one after the other, are a random permutation of the table; shards are equal
stretches of it, so that their row counts differ by one at most (law "rows").

Bucket number and shuffle depend on key, text and seed alone, so a rerun, or a
task that runs again after an executor was lost, gives the same order. Rows
whose key is repeated more often than a bucket should hold are spread by their
place in the input as well; such rows are interchangeable only if their texts
are equal too, so for them the input should be a table rather than a query.

Defined results: a null text has no bytes, a null key is a key like any other;
repeated rows each get a slot; an empty table gives no shards; extra columns
go along, except those named ``shard``, ``slot`` or ``bucket``, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import saved, shared_folder

BUCKET_BYTES = 8 << 20
#: Larger tables get larger buckets, so that lists of one entry per bucket stay small enough to broadcast.
MOST_BUCKETS = 1_000_000


def scatter(docs: DataFrame, n_buckets: int, bucket_rows: int, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs as (bucket, order, row): the first pass."""
    # A key with more rows than a bucket should have; of these there are n_buckets at most.
    hot = docs.groupBy(F.col(key).alias("_hot")).count().filter(F.col("count") > bucket_rows).select("_hot", F.lit(True).alias("_is_hot"))
    marked = docs.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left")
    place = F.when(F.col("_is_hot"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    own = [c for c in docs.columns if c not in ("bucket", "shard", "slot")]
    return marked.select(F.xxhash64(F.lit(seed), F.col(key), F.xxhash64(F.col(text)), place).alias("order"), F.struct(*[docs[c] for c in own]).alias("row")).select(
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("order")), F.lit(n_buckets)).alias("bucket"), "order", "row"
    )


def external_shuffle(docs: DataFrame, seed: int = 23, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with ``position`` (long, from 0): their place in one random permutation of the table.

    The driver learns three totals, nothing that grows.
    """
    rows, volume = docs.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()
    n_buckets = max(1, -(-(volume or 0) // max(bucket_bytes, (volume or 0) // MOST_BUCKETS)))
    scattered = scatter(docs, n_buckets, max(1, rows // n_buckets), seed, key, text)
    by_order = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
    # repartition first: a bucket is then collected where it is read, without a second exchange. Its fixed number of
    # partitions and their sorted buckets make the shuffle's random numbers the same in every run.
    buckets = scattered.repartition(n_buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("order", "row")), by_order).alias("rows")).sortWithinPartitions("bucket")
    written = saved(buckets.select("bucket", F.posexplode(F.shuffle("rows", seed=seed)).alias("at", "x")).select("bucket", "at", "x.row"), "buckets")
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("bucket", "start")
    return written.join(F.broadcast(starts), "bucket").select("row.*", (F.col("start") + F.col("at")).alias("position"))


def shard(docs: DataFrame, n_shards: int = 16, **options) -> DataFrame:
    """docs with ``shard`` and ``slot`` (gapless from 0 in each shard); counts differ by one at most."""
    base, extra = divmod(docs.count(), n_shards)
    placed = external_shuffle(docs, **options)
    p = F.col("position")
    wide = (base + 1) * extra  # the first `extra` shards have one row more
    number = F.when(p < wide, F.floor(p / (base + 1))).otherwise(extra + F.floor((p - wide) / max(base, 1)))
    start = F.when(p < wide, F.col("shard") * (base + 1)).otherwise(wide + (F.col("shard") - extra) * base)
    return placed.withColumn("shard", number.cast("int")).withColumn("slot", (p - start).cast("long")).drop("position")


def write_shards(sharded: DataFrame, folder: str | None = None) -> str:
    """One folder per shard, rows in slot order in each of its files; returns the place.

    Buckets are stretches of the permutation, so tasks write where they read:
    no further exchange, and no task holds a whole shard.
    """
    folder = folder or shared_folder(sharded.sparkSession, "shards")
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return folder
