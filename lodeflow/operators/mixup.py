"""Mixup of training rows: batches of a shuffled epoch, a random partner for each row, one Beta variate for each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.scalars import seeded_uniform
from lodeflow.operators.split import epoch_order

#: Pairs of uniform numbers that a variate may reject; with alpha up to 1 one in two is taken at least.
TRIES = 32


def beta_variate(key: Column, alpha: float, seed: int) -> Column:
    """A Beta(alpha, alpha) variate for each key, 0 < alpha <= 1, from seeded uniform numbers alone.

    Of pairs u ** (1 / alpha), v ** (1 / alpha) the first with a sum of at most 1 gives its first part over the sum.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0 and 1 at most")
    drawn = lambda j, side: F.pow(seeded_uniform(F.concat(key.cast("string"), F.lit(f":{side}:"), j.cast("string")), seed), F.lit(1 / alpha))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda j: F.struct(drawn(j, "u").alias("x"), drawn(j, "v").alias("y")))
    first = F.get(F.filter(pairs, lambda p: (p["x"] + p["y"] <= 1) & (p["x"] + p["y"] > 0)), F.lit(0))
    return F.coalesce(first["x"] / (first["x"] + first["y"]), F.lit(0.5))


def mixed_batches(df: DataFrame, alpha: float, size: int, seed: int = 42, epoch: int = 0, key: str = "id") -> DataFrame:
    """df with batch, partner (the key of the row that its own is mixed with) and lam, the own part, from 0.5 to 1.

    Batches are size rows of the epoch's shuffle. Within a batch a second order deals the partners, so they are a permutation
    of its rows; lam is the batch's. A batch is all that a window holds. Keys are distinct; rows without a key are left out.
    """
    placed = epoch_order(df.where(F.col(key).isNotNull()), seed, epoch, key).withColumn("batch", F.expr(f"position div {int(size)}"))
    within = Window.partitionBy("batch")
    other = F.row_number().over(within.orderBy(F.md5(F.concat(F.lit(f"{seed}:{epoch}:partner:"), F.col(key).cast("string"))), key))
    placed = placed.withColumn("own", F.row_number().over(within.orderBy("position"))).withColumn("other", other)
    partners = placed.select("batch", F.col("other").alias("own"), F.col(key).alias("partner"))
    draw = beta_variate(F.concat(F.lit(f"{epoch}:"), F.col("batch").cast("string")), alpha, seed)
    lams = placed.select("batch").distinct().withColumn("lam", draw).withColumn("lam", F.greatest(F.col("lam"), 1 - F.col("lam")))
    return placed.join(partners, ["batch", "own"]).join(lams, "batch").drop("own", "other", "position")
