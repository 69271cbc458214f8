"""Bounded samples of labelled documents, and a classifier fitted on one by one task of the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeflow.llm.hashed_linear import HashedLinear, train
from lodeflow.llm.words import release

#: Texts above so many bytes stand in no sample, and a sample ends before it holds more than so many bytes.
SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 64 << 10, 16 << 20


def short_enough(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_TEXT_BYTES


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """rank, text and target of at most per_class documents of each of the classes 0 and 1, by the hash of their id.

    labels: doc_id and the label column. Null ids and labels, and ids labelled both ways, are left out. Of an id with
    several rows the text with the least hash counts; texts above SAMPLE_TEXT_BYTES are left out.
    """
    clean = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("rank"))
    )
    chosen = None
    for value in (0, 1):
        part = clean.where(F.col("label") == value).orderBy("rank", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & short_enough("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("rank", "doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"))
    return rows.select("rank", F.col("least.text").alias("text"), F.col("label").cast("double").alias("target"))


def fit_in_task(sample: DataFrame) -> HashedLinear:
    """HashedLinear fitted on a sample (rank, text, target) in order of rank, both sides of 0.5 with equal weight.

    The sample is bounded, so one task holds it; what comes back are the weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(b.column(x).to_pylist() for x in ("rank", "text", "target")), strict=True)))
        room = np.cumsum([len(t.encode()) for _, t, _ in rows]) <= SAMPLE_BYTES if rows else np.zeros(0, bool)
        rows = [r for r, fits in zip(rows, room, strict=True) if fits]
        target = np.array([y for _, _, y in rows])
        share = (target >= 0.5).mean() if len(target) else 0.5
        weight = np.where(target >= 0.5, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        model = train([t for _, t, _ in rows], target, weight)
        fitted = [[np.asarray(model.weights, np.float32).tobytes()], [model.bias], [model.slope], [model.shift]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in fitted], names=["weights", "bias", "slope", "shift"])
        release()

    found = sample.select("rank", "text", "target").repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    if found is None:  # an empty sample has no task
        return train([], np.zeros(0), np.zeros(0))
    return HashedLinear.of(found.weights, found.bias, found.slope, found.shift)
