"""Sinks for manifests, anomalies and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.functions.scalars import class_name


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def submission(df: DataFrame, name: str = "filename", pred: str = "pred") -> DataFrame:
    """filename and the class in four digits, ordered by filename."""
    return df.select(F.col(name).alias("filename"), class_name(F.col(pred)).alias("class_name")).orderBy("filename")


def write_submission(df: DataFrame, path: str, name: str = "filename", pred: str = "pred") -> None:
    """Without a header, compressed."""
    submission(df, name, pred).write.mode("overwrite").option("compression", "gzip").csv(path, header=False)


def write_features(df: DataFrame, path: str, fingerprint: str) -> None:
    """Vectors by id with the fingerprint of the settings that made them."""
    df.select("id", F.col("z").cast("array<float>").alias("z"), F.lit(fingerprint).alias("fingerprint")).write.mode("overwrite").parquet(path)


def check_fingerprint(df: DataFrame, fingerprint: str) -> DataFrame:
    """df, which fails when read if a row was made with other settings."""
    return df.where(F.assert_true(F.col("fingerprint") == fingerprint, F.lit("features were made with other settings")).isNull())


def write_arrays(df: DataFrame, path: str, columns: list[str], key: str = "id") -> list[str]:
    """The named number columns of df by key in one wide table; those with no value at all are left out. Returns what was written."""
    there = df.agg(*(F.count(c).alias(c) for c in columns)).first().asDict()
    kept = [c for c in columns if there[c]]
    df.select(key, *kept).write.mode("overwrite").parquet(path)
    return kept


def place_after(df: DataFrame, name: str, after: str) -> DataFrame:
    """df with the column name moved to right behind the column after."""
    rest = [c for c in df.columns if c != name]
    at = rest.index(after) + 1
    return df.select(*rest[:at], name, *rest[at:])


def remap_by_archive_path(df: DataFrame, root: str) -> DataFrame:
    """df with path made of root and archive_path anew; KeyError if either column is missing."""
    for name in ("path", "archive_path"):
        if name not in df.columns:
            raise KeyError(f"column {name} is missing")
    return df.withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), "archive_path"))
