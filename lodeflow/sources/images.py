"""Class folders of files, flat folders, tables and text logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeflow.functions.scalars import IMAGE_EXTENSIONS, PREDICT_EXTENSIONS, digest, has_extension, image_header
from lodeflow.operators.audit import class_index

MANIFEST = (
    "id BIGINT, path STRING, archive_path STRING, orig_label STRING, class_idx INT, width INT, height INT, aspect_ratio DOUBLE, mode STRING, "
    "decodable BOOLEAN, file_size BIGINT, crc32 STRING, file_hash STRING, phash STRING, error STRING"
)


def scan_class_folders(spark: SparkSession, root: str, algorithm: str = "sha256") -> DataFrame:
    """path, label, class_idx, width, height, aspect_ratio, mode, file_size, file_hash and error of the image files in root/<label>/.

    The label is the folder; its class is the rank among all folders with any file, so a folder without images keeps its
    number. error says why a file is an anomaly (its bytes are no whole image of a known kind, or its header states a side
    of 0), null where it is none.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = class_index(raw.withColumn("label", F.element_at(F.split("path", "/"), -2)))
    files = files.where(has_extension(F.col("path"), IMAGE_EXTENSIONS))
    files = files.withColumn("header", image_header(F.col("content")))
    empty = (F.col("header.width") == 0) | (F.col("header.height") == 0)
    error = F.when(F.col("length") == 0, "empty").when(F.col("header.kind").isNull() | empty, "undecodable")
    stated = [F.col(f"header.{c}") for c in ("width", "height", "aspect_ratio", "mode")]
    return files.select("path", "label", "class_idx", *stated, F.col("length").alias("file_size"), digest(F.col("content"), algorithm).alias("file_hash"), error.alias("error"))


def list_predict_files(spark: SparkSession, root: str) -> DataFrame:
    """path of the files to predict in root, ordered."""
    raw = spark.read.format("binaryFile").load(root).select("path")
    return raw.where(has_extension(F.col("path"), PREDICT_EXTENSIONS)).orderBy("path")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from CSV with its fixed types, so labels like 0007 stay strings and empty numbers are null."""
    return spark.read.schema(MANIFEST).csv(path, header=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """line_no from 0 and line of each line of the text files at path, in order within its file.

    Files are read in splits; a line's place is its split's start and its place there.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.col("value").alias("line"))
    return lines.select((F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).alias("line_no"), "line")


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


