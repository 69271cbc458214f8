"""Whole curation plans made of the operators: audit to split, features to reliability, reliability to training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.operators import audit, dedup, reliability, split
from lodeflow.session import materialize


def audit_archive(entries: DataFrame, existing: DataFrame, depth: int) -> DataFrame:
    """What becomes of each archive entry: file_hash, label, class_idx, error, outcome and status beside its own columns.

    entries: entry_no, path, encrypted, size, declared_size, decodable, content; existing: path and file_hash of what is
    written already (path normalized, once each). outcome is accepted or quarantined, status of an accepted entry written
    or reused. class_idx is the label's rank among the labels of all safe paths, so a class without an accepted entry
    keeps its number. A null content has no hash and meets no conflict.
    """
    there = existing.select(F.col("path").alias("norm_path"), F.col("file_hash").alias("existing_hash"))
    hashed = audit.normalized(entries.withColumn("file_hash", F.sha2("content", 256))).drop("depth", "label", "repeated")
    told = audit.class_index(audit.validate(hashed.join(there, "norm_path", "left").drop("norm_path"), depth))
    ok = F.col("error").isNull()
    status = F.when(ok, F.when(F.col("existing_hash").isNull(), "written").otherwise("reused"))
    return told.withColumn("outcome", F.when(ok, "accepted").otherwise("quarantined")).withColumn("status", status).drop("existing_hash")


def audit_to_split(manifest: DataFrame, radius: int = 8, val_ratio: float = 0.1, folds: int = 3, seed: int = 42, rule: str = "greedy") -> DataFrame:
    """Decodable rows of manifest (id, class_idx, file_hash, h, decodable) with group_id, fold and part; groups never span folds.

    rule: greedy (split.split_greedy, bounded by the driver) or quota (split.split_quota, windows only).
    """
    grouped = materialize(dedup.build_groups(manifest.where("decodable"), radius))
    rules = {"greedy": split.split_greedy, "quota": split.split_quota}
    return split.assign_parts(rules[rule](grouped, val_ratio, folds=folds, seed=seed))


def meeting(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """One row: left_rows, right_rows, and the numbers of keys that are matched, left_only, right_only and repeated on a side.

    Both sides are counted by key before they meet, so a frequent key is one row. Null keys are one key. Empty tables give zeros.
    """
    side = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name)).withColumnRenamed(key, f"{name}_key")
    met = side(left, "l").join(side(right, "r"), F.col("l_key").eqNullSafe(F.col("r_key")), "full")
    l, r = F.coalesce("l", F.lit(0)), F.coalesce("r", F.lit(0))
    number = lambda rows: F.count(F.when(rows, 1))
    return met.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        number((l > 0) & (r > 0)).alias("matched"),
        number(r == 0).alias("left_only"),
        number(l == 0).alias("right_only"),
        number((l > 1) | (r > 1)).alias("repeated"),
    )


def aligned(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """The rows of both sides by key; an error tells the counts if any key is missing, null or repeated on a side."""
    found = meeting(left, right, key).first()
    if found.left_only or found.right_only or found.repeated:
        raise ValueError(f"rows do not meet one to one by {key}: {found.asDict()}")
    met = left.join(right, key)
    if left.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"{key} is null in a row")
    return met


def features_to_q0(features: DataFrame, folds: int = 3, k: int = 20) -> DataFrame:
    """features (id, y, g, z, fold) with q0; null for rows of the fold val, which take no part."""
    train = features.where("fold <> 'val'")
    scored = reliability.compute_q0(split.group_kfold(train, folds, group="g"), folds=folds, k=k)
    return features.join(scored.select("id", "q0"), "id", "left")


def training_rows(scored: DataFrame) -> DataFrame:
    """Rows outside val whose hash is not under several labels, with the weight of their duplicates."""
    kept = dedup.conflict_mask(scored).where((F.col("fold") != "val") & ~F.col("conflict"))
    return dedup.dup_weight(kept.drop("conflict"))


def validation_rows(scored: DataFrame) -> DataFrame:
    """Rows of the fold val, each with weight 1."""
    return scored.where("fold = 'val'").withColumn("weight", F.lit(1.0))
