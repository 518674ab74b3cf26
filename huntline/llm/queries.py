"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, katz, license_scan, line_dedup, mixing, negatives, quality_classifier, quality_rules, sharding, simhash, spelling, sql, substring_dedup, token_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op6_quality_rules", sql.QUALITY_RULES)
def op6(spark, folder):
    entries = quality_rules.ledger(table(spark, folder, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v2").alias("kept"), "n_lines", "n_exclaims", "fail_bits",
    )


@query("op7_mixing")
def op7(spark, folder):
    planned = mixing.plan(table(spark, folder, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op9_sharding")
def op9(spark, folder):
    shards = spark.read.parquet(sharding.write_shards(sharding.shard(table(spark, folder, "documents"))))
    return shards.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op1_simhash_near_dedup")
def op1(spark, folder):
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_benchmark_decontamination", sql.DECONTAMINATION)
def op3(spark, folder):
    told = decontamination.verdicts(table(spark, folder, "documents"), table(spark, folder, "benchmark"), slop=8)
    return told.select(F.col("doc").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


@query("op8_token_files")
def op8(spark, folder):
    manifest = token_files.write(table(spark, folder, "documents"), tokenizer_path(), end_id=2)
    return token_files.read(manifest).withColumnRenamed("key", "doc_id")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_substring_dedup", sql.SUBSTRING_DEDUP)
def op4(spark, folder):
    cut = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_quality_classifier")
def op2(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality_classifier.fit(docs, labels.filter(~held_out).select("doc_id", F.col("quality").alias("label")))
    return quality_classifier.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_katz_backoff")
def op10(spark, folder):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    told = katz.scored(table(spark, folder, "documents"), ~held_out)
    return told.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op5_license_scans")
def op5(spark, folder):
    return license_scan.scan(table(spark, folder, "documents"))


@query("op13_line_dedup", sql.LINE_DEDUP)
def op13(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = line_dedup.kept(docs, line_dedup.bitmaps(docs), n_lines="n_lines", n_dropped="n_dropped")
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op11_spelling_variants")
def op11(spark, folder):
    return spelling.spelling_variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_hard_negatives", sql.HARD_NEGATIVES)
def op12(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)
