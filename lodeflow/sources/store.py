"""A write-once store of files: staged whole, then committed by one rename."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.session import materialize


def stored(spark: SparkSession, path: str) -> DataFrame:
    """path, label, file_hash and content of what the store at path holds; nothing of a call that did not end."""
    try:
        return spark.read.schema("path string, file_hash string, content binary, label string").parquet(path)
    except AnalysisException:  # nothing is there yet
        return spark.createDataFrame([], "path string, file_hash string, content binary, label string")


def write_status(files: DataFrame, old: DataFrame) -> DataFrame:
    """path, file_hash, n (rows) and status of each distinct (path, file_hash) of files, against old (path, file_hash; a path once).

    reused: old holds this content under the path. written: the path is new, and of the contents that files holds for it
    this has the least hash. conflict: old or files hold another content under the path, or path or hash is null. Rows alike are
    counted before anything is sent, so a path that is repeated very often fills no task.
    """
    each = files.groupBy("path", "file_hash").agg(F.count("*").alias("n"))
    chosen = files.groupBy(F.col("path").alias("_path")).agg(F.min("file_hash").alias("_chosen"))
    there = old.select(F.col("path").alias("_there"), F.col("file_hash").alias("_old"))
    met = each.join(chosen, F.col("path") == F.col("_path"), "left").join(there, F.col("path") == F.col("_there"), "left")
    status = (
        F.when(F.col("path").isNull() | F.col("file_hash").isNull(), "conflict")
        .when(F.col("_there").isNotNull(), F.when(F.col("_old") == F.col("file_hash"), "reused").otherwise("conflict"))
        .otherwise(F.when(F.col("_chosen") == F.col("file_hash"), "written").otherwise("conflict"))
    )
    return met.select("path", "file_hash", "n", status.alias("status"))


def _renamed(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if not source.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def write_once(files: DataFrame, path: str) -> DataFrame:
    """Add the files (path, label, file_hash, content) that the store at path does not hold yet; what is there is never overwritten.

    Returns write_status; one content is stored for each written path, conflicts are not stored. New files go to a folder that
    readers do not see. It is renamed to a batch of the store, in one step, once it holds all of them; a call that fails
    before leaves the store as it was, and the next call begins anew. One call writes at a time.
    """
    spark, path = files.sparkSession, path.rstrip("/")
    status = materialize(write_status(files.select("path", "file_hash"), stored(spark, path)))
    new = status.where("status = 'written'").select("path", "file_hash")
    n = new.count()
    if not n:
        return status
    batch = uuid.uuid4().hex
    staging = f"{path}/_staging-{batch}"
    rows = files.select("path", "file_hash", "content", "label").join(new, ["path", "file_hash"], "left_semi").dropDuplicates(["path"])
    rows.write.partitionBy("label").parquet(staging)
    whole = spark.read.parquet(staging).count()
    if whole != n:
        raise OSError(f"{staging} holds {whole} of {n} files")
    _renamed(spark, staging, f"{path}/batch={batch}")
    return status
