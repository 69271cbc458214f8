"""Auditing archives and manifests: paths, validation, class indices, fingerprints, write-once status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions import scalars as S
from lodeflow.session import materialize

# What a rejected entry is told, in the order in which the rules apply.
ERRORS = ("unsafe_path", "duplicate_path", "wrong_depth", "bad_extension", "encrypted", "empty", "length_mismatch", "undecodable", "write_conflict")


def decodable(manifest: DataFrame) -> DataFrame:
    return manifest.where("decodable")


def normalized(entries: DataFrame) -> DataFrame:
    """entries (entry_no, path) with norm_path (null if unsafe), depth, label (first part) and repeated.

    repeated marks every later entry of a path, the one with the smallest entry_no is the first.
    """
    norm = S.safe_path(F.col("path"))
    found = entries.withColumn("norm_path", norm).withColumn("depth", F.coalesce(F.size(S.path_parts(F.col("norm_path"))), F.lit(0)))
    first = found.where("norm_path IS NOT NULL").groupBy("norm_path").agg(F.min("entry_no").alias("first_no"))
    found = found.join(first, "norm_path", "left")
    return found.withColumn("label", F.get(S.path_parts(F.col("norm_path")), F.lit(0))).withColumn("repeated", F.coalesce(F.col("entry_no") > F.col("first_no"), F.lit(False))).drop("first_no")


def validate(entries: DataFrame, depth: int) -> DataFrame:
    """entries with error, the first rule that fails, or null.

    entries: entry_no, path, encrypted, size, declared_size, decodable, existing_hash, file_hash. Nulls in a
    rule's columns do not fail it.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    rules = (
        F.col("norm_path").isNull(),
        F.col("repeated"),
        F.col("depth") != depth,
        ~S.has_extension(F.col("norm_path")),
        no(F.col("encrypted")),
        no(F.col("size") == 0),
        no(F.col("size") != F.col("declared_size")),
        ~F.coalesce(F.col("decodable"), F.lit(True)),
        no(F.col("existing_hash") != F.col("file_hash")),
    )
    return normalized(entries).withColumn("error", F.coalesce(*(F.when(rule, F.lit(name)) for rule, name in zip(rules, ERRORS, strict=True))))


def write_status(new: DataFrame, existing: DataFrame) -> DataFrame:
    """path, file_hash and status of new files: written, reused (the same content is there), or conflict."""
    old = existing.select("path", F.col("file_hash").alias("old_hash"))
    status = F.when(F.col("old_hash").isNull(), "written").when(F.col("old_hash") == F.col("file_hash"), "reused").otherwise("conflict")
    return new.join(old, "path", "left").select("path", "file_hash", status.alias("status"))


def class_index(df: DataFrame, label: str = "label", name: str = "class_idx") -> DataFrame:
    """df with the rank from 0 of its label among the sorted distinct labels. Labels are few: their table is broadcast below 100,000."""
    labels = df.where(F.col(label).isNotNull()).select(label).distinct()
    ranked = labels.withColumn(name, (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))
    return df.join(ranked, label, "left")


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: entries, accepted, anomalies, and the written, reused and distinct labels among the accepted."""
    ok = F.col("error").isNull()
    return audited.agg(
        F.count("*").alias("entries"),
        F.count_if(ok).alias("accepted"),
        F.count_if(~ok).alias("anomalies"),
        F.count_if(ok & (F.col("status") == "written")).alias("written"),
        F.count_if(ok & (F.col("status") == "reused")).alias("reused"),
        F.count_distinct(F.when(ok, F.col("label"))).alias("labels"),
    )


def dataset_fingerprint(df: DataFrame, path: Column, content: Column, digits: int = 2) -> DataFrame:
    """One row: n and the SHA-256 of a dataset, whatever files hold it.

    Lines `path \\0 hash \\n` are sorted and hashed within each bucket of paths (by the first digits of their own
    hash), and the sorted bucket hashes are hashed together. So no task ever holds all lines; more digits give
    smaller buckets and another fingerprint. A null hash counts as an empty one, a null path as an empty path.
    """
    line = F.concat(F.coalesce(path, F.lit("")), F.lit("\0"), F.coalesce(content, F.lit("")), F.lit("\n"))
    lines = df.select(line.alias("line"), F.substring(F.sha2(F.coalesce(path, F.lit("")), 256), 1, digits).alias("bucket"))
    buckets = lines.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("h"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda b: F.concat(b["bucket"], b["h"])), ""), 256).alias("fingerprint"))


#: Lines that a leaf of the fingerprint tree holds, about.
LEAF_LINES = 1024


def fingerprint_tree(df: DataFrame, path: Column, content: Column, per_leaf: int = LEAF_LINES) -> DataFrame:
    """One row: n and the SHA-256 root of a hash tree over a dataset's lines, whatever files hold them, however they are packed.

    A line is `path \\0 hash \\n` (nulls count as empty); its own SHA-256 says where it belongs, so the tree's cuts depend on the
    lines alone. Leaves are the prefixes of as many hexadecimal digits as give per_leaf lines a leaf or fewer on average; a leaf
    hashes its lines' hashes with how often each line stands, in order; a node hashes its at most 16 children. So a task
    holds about per_leaf lines at a time, also where one path or line stands for a third of the rows.
    """
    line = F.concat(F.coalesce(path, F.lit("")), F.lit("\0"), F.coalesce(content, F.lit("")), F.lit("\n"))
    lines = materialize(df.select(F.sha2(line, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n")))
    sizes = lines.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    depth = 0
    while sizes.distinct > per_leaf * 16**depth:
        depth += 1
    told = F.array_join(F.array_sort(F.collect_list(F.concat("h", F.lit(":"), F.col("n").cast("string")))), "\n")
    nodes = lines.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.sha2(told, 256).alias("h"))
    for size in range(depth - 1, -1, -1):
        told = F.array_join(F.array_sort(F.collect_list(F.concat("prefix", F.lit(":"), "h"))), "\n")
        nodes = nodes.groupBy(F.substring("prefix", 1, size).alias("prefix")).agg(F.sha2(told, 256).alias("h"))
    root = nodes.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("fingerprint"))  # one row, or none of an empty dataset
    return root.select(F.lit(sizes.n).cast("bigint").alias("n"), "fingerprint")


def assert_counts(df: DataFrame, expected: dict[str, int]) -> None:
    """Raise if the one row of df differs from the expected counts."""
    row = df.first().asDict()
    wrong = {k: (row.get(k), v) for k, v in expected.items() if row.get(k) != v}
    if wrong:
        raise ValueError(f"counts differ (found, expected): {wrong}")


def sampled_check(df: DataFrame, key: str, order: str, readable: Column, most: int = 5) -> DataFrame:
    """One row: keys, rows, and the unreadable among each key's first rows in order.

    The limit on the place is known to the planner, so a task keeps the first rows of each key before anything is sent.
    """
    seen = df.select(key, order, readable.alias("_readable"))
    first = seen.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_place") <= most)
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).agg(F.count(key).alias("classes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("images"))
    return counts.join(first.agg(F.count_if(~F.col("_readable")).alias("unreadable")))
