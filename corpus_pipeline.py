"""From raw documents to packed training sequences: four stages, each one of the operators in lodeflow.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm import packing, quality_classifier, quality_rules
from lodeflow.llm.ngram_jaccard import jaccard_rows, row_key
from lodeflow.session import materialize

#: Near duplicates share this percentage of their runs of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
WORD = r"[^\x20\x09-\x0D]"


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the rules' classifier learns from the labels of these documents.

    A null, empty or very short text has too few words and goes. Equal texts are judged alike, repeated rows and null
    ids stay or go with their text, and an empty table (or one without labels) gives what the base rules keep.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels))


def apply_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained quality classifier keeps.

    A null or empty text gets the scorer's bias only. Equal texts are judged alike, repeated rows and null ids stay or
    go with their text; an empty table gives an empty one.
    """
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: that with the smallest id, and of these that with the least row key.

    Rows are told apart by id and text, so unlike texts under one id are judged each for itself; of rows alike in both
    one stays, with any of their other columns. A null id comes after all others. A document without words links with
    nothing and stays; an empty table gives an empty one; other columns are handed on, whatever their names.
    """
    found = jaccard_rows(docs, NEAR_WORDS, NEAR_PERCENT).where("component IS NOT NULL")
    rows = found.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "n")).alias("head")
    heads = materialize(rows.groupBy("component").agg(first).select(F.col("head.key").alias("_row_key"), "head.n"))
    marked = docs.select(row_key().alias("_row_key"), F.struct("*").alias("_row"))
    single = marked.join(heads.where("n = 1"), "_row_key", "left_semi")
    repeated = marked.join(heads.where("n > 1"), "_row_key", "left_semi").dropDuplicates(["_row_key"])
    wordless = docs.where(F.col("text").isNull() | ~F.col("text").rlike(WORD))
    return single.unionByName(repeated).select("_row.*").unionByName(wordless)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: every row, repeated, null or long, as lodeflow.llm.packing.pack states."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES = [
    ("quality rules", apply_rules),
    ("quality classifier", apply_classifier),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
