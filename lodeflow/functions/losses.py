"""Losses and schedules as Column expressions and aggregates. logits is an array, label an index from 0, q a reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.functions.vectors import dot, log_softmax, total

EPSILON = 1e-8


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.get(log_softmax(logits), label.cast("int"))


def soft_cross_entropy(logits: Column, target: Column) -> Column:
    return -total(F.zip_with(target, log_softmax(logits), lambda y, p: y * p))


def smoothed_cross_entropy(logits: Column, label: Column, eps: float) -> Column:
    """Cross-entropy with (1 - eps) on the label and eps spread evenly over all classes."""
    logp = log_softmax(logits)
    return -(F.lit(1 - eps) * F.get(logp, label.cast("int")) + F.lit(eps) * total(logp) / F.size(logits))


def own_probability(logits: Column, label: Column) -> Column:
    return F.greatest(F.exp(F.get(log_softmax(logits), label.cast("int"))), F.lit(EPSILON))


def gce(logits: Column, label: Column, q: float = 0.7) -> Column:
    """Generalised cross-entropy (1 - p ** q) / q."""
    return (F.lit(1.0) - F.pow(own_probability(logits, label), F.lit(q))) / F.lit(q)


def anchor(z: Column, z0: Column, reliability: Column, low: float = 0.1, more: float = 0.9) -> Column:
    """(low + more * (1 - q)) * (1 - z . z0), q clipped to 0 .. 1."""
    q = F.least(F.greatest(reliability, F.lit(0.0)), F.lit(1.0))
    return (F.lit(low) + F.lit(more) * (1 - q)) * (1 - dot(z, z0))


def weighted_mean(loss: Column, weight: Column) -> Column:
    """Aggregate: sum of weight * loss over sum of weight + 1e-8, weights below 0 count 0."""
    w = F.greatest(weight, F.lit(0.0))
    return F.sum(w * loss) / (F.sum(w) + EPSILON)


SUPERVISED = ("ce_plain", "ce", "gce_plain", "gce")


def total_loss(rows: DataFrame, supervised: str = "gce", anchor_weight: float = 1.0, hard_drop: float | None = None, q: float = 0.7) -> DataFrame:
    """One row: supervised, anchor and total of rows (logits, label, reliability, z, z0).

    ce and gce weigh rows by reliability, and rows strictly below hard_drop count nothing there; ce_plain and
    gce_plain are plain means, on which hard_drop has no effect. The anchor takes all rows.
    """
    if supervised not in SUPERVISED:
        raise ValueError(f"unknown loss {supervised!r}")
    each = cross_entropy(F.col("logits"), F.col("label")) if supervised.startswith("ce") else gce(F.col("logits"), F.col("label"), q)
    weight = F.col("reliability")
    if hard_drop is not None:
        weight = F.when(weight < hard_drop, 0.0).otherwise(weight)
    loss = F.avg(each) if supervised.endswith("plain") else weighted_mean(each, weight)
    held = rows.agg(loss.alias("supervised"), F.avg(anchor(F.col("z"), F.col("z0"), F.col("reliability"))).alias("anchor"))
    return held.select("supervised", "anchor", (F.col("supervised") + F.lit(anchor_weight) * F.col("anchor")).alias("total"))


def lr_schedule(spark: SparkSession, steps: int, warmup: int) -> DataFrame:
    """step and factor: linear to 1 over warmup steps, then a cosine to 0; 1 throughout the rest if steps <= warmup."""
    s = F.col("step").cast("double")
    ramp = F.when(F.col("step") < warmup, (s + 1) / F.lit(float(max(1, warmup))))
    rest = F.lit(1.0) if steps <= warmup else 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (s - warmup) / F.lit(float(steps - warmup))))
    return spark.range(steps).select(F.col("id").alias("step")).select("step", ramp.otherwise(rest).alias("factor"))


def layer_rates(spark: SparkSession, layers: int, rate: float, decay: float) -> DataFrame:
    """layer and rate: rate * decay ** (layers - 1 - layer)."""
    return spark.range(layers).select(F.col("id").alias("layer"), (F.lit(rate) * F.pow(F.lit(decay), F.lit(layers - 1) - F.col("id"))).alias("rate"))
