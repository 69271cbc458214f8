"""Session building and the shared scratch folder of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "lodeflow", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor shares.

    A local session that names no such folder (as in tests) takes one of this machine; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="lodeflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodeflow/{uuid.uuid4().hex}"


def materialize(df: DataFrame, drop_shuffles: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors.

    drop_shuffles: the shuffle files of this write go when it ends, not when the driver happens to collect its garbage
    (a setting of Spark 4.1).
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    if drop_shuffles:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let no Arrow batch hold more than most bytes, however long its texts are; a lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = spark.conf.get(key).lower().rstrip("b")
    if not text.isdigit() or int(text) > most:
        spark.conf.set(key, str(most))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
