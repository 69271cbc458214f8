"""Mixup's permutations and variates, the fingerprint tree, and the mixture's gates."""

import random
from statistics import fmean, pvariance

import pytest
from pyspark.sql import functions as F

from lodeflow.operators import audit, mixup, reliability


def test_partners_are_a_permutation_of_each_batch(spark):
    rows = mixup.mixed_batches(spark.range(1000).select("id"), 0.3, 64).collect()
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r)
    assert len(rows) == 1000 and sorted(len(b) for b in batches.values()) == [40] + [64] * 15
    for b in batches.values():
        assert sorted(r.id for r in b) == sorted(r.partner for r in b) and len({r.lam for r in b}) == 1 and 0.5 <= b[0].lam <= 1
    assert sum(r.id == r.partner for r in rows) < 60
    assert [r.partner for r in sorted(mixup.mixed_batches(spark.range(1000).repartition(7).select("id"), 0.3, 64).collect())] == [r.partner for r in sorted(rows)]


@pytest.mark.parametrize("alpha", [0.2, 0.5, 1.0])
def test_beta_variates(spark, alpha):
    drawn = [r.x for r in spark.range(6000).select(mixup.beta_variate(F.col("id"), alpha, 1).alias("x")).collect()]
    assert abs(fmean(drawn) - 0.5) < 0.02 and abs(pvariance(drawn) - 1 / (4 * (2 * alpha + 1))) < 0.01
    with pytest.raises(ValueError):
        mixup.beta_variate(F.col("id"), 1.5, 1)


def test_fingerprint_tree(spark):
    rows = [(str(i % 300), f"h{i % 7}") for i in range(900)] + [(None, None), ("one", "x")] + [("one", "x")] * 400
    df = spark.createDataFrame(rows, "p string, h string")
    tree = lambda d, n=16: tuple(audit.fingerprint_tree(d, F.col("p"), F.col("h"), n).first())
    first = tree(df)
    assert first[0] == len(rows) and first == tree(df.repartition(9)) == tree(df.orderBy("p").coalesce(1))
    assert tree(df.where("p <> '5' OR p IS NULL"))[1] != first[1]
    assert tree(df.union(spark.createDataFrame([("one", "x")], df.schema)))[1] != first[1]
    assert tree(df, 10**6)[0] == len(rows) and tree(df.where("false"))[0] == 0 and tree(df.limit(1), 1)[0] == 1


def told(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, loss double")
    found = reliability.gmm_signal(df, **options)
    return None if found is None else {r.id: r.gmm for r in found.collect()}


def test_the_mixture_separates_and_its_gates_hold(spark):
    draw = random.Random(3)
    values = [round(draw.gauss(0.2, 0.05), 6) for _ in range(300)] + [round(draw.gauss(2.0, 0.3), 6) for _ in range(250)]
    found = told(spark, values)
    assert all(found[i] > 0.9 for i in range(300)) and all(found[i] < 0.1 for i in range(300, 550))
    assert told(spark, values[:150]) is None  # too few rows
    assert told(spark, values[:300] + values[300:340]) is None  # a cluster that is too small
    # a split that has little to do with the median
    assert told(spark, values, gain=0.6) is None
    assert told(spark, [1.0] * 300) is None
