"""Session defaults and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "huntline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on; everything else stays as the cluster has it."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Call-site capture per column costs more than planning itself for large rule sets.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and cuts the lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; a
    temporary folder is chosen only where the setting is absent and the
    session runs in a single local process.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="huntline-ckpt-")
        sc.setCheckpointDir(configured)
    return df.checkpoint(eager=True)
