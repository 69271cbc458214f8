"""Two-level places and ranks against plain windows, with a class that holds half of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeflow.operators import audit, ranks, split


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    told = [(i, draw.choice([0] * 5 + [1, 2, 3, None]), draw.choice([None, *range(12)]), float(draw.randrange(40))) for i in range(900)]
    return spark.createDataFrame(told + [(900, 77, 1, 1.0)], "id long, c int, v int, w double").repartition(6)


def both(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("frequent", [0, 150, 10**6])
def test_same_as_windows(rows, frequent):
    by = Window.partitionBy("c")
    rank = F.rank().over(by.orderBy("v")) + (F.count("*").over(Window.partitionBy("c", "v")) - 1) / F.lit(2.0)
    n = F.count("*").over(by)
    assert both(ranks.average_rank(rows, "v", "c", "r", frequent)) == both(rows.withColumn("r", F.when(n <= 1, 0.5).otherwise((rank - 1) / (n - 1))))
    assert both(ranks.place_within(rows, "c", F.desc("v"), F.col("id"), frequent=frequent)) == both(rows.withColumn("place", F.row_number().over(by.orderBy(F.desc("v"), "id")) - 1))
    twice = ranks.average_ranks(rows, {"v": "r", "w": "s"}, "c", frequent)
    assert both(twice) == both(ranks.average_rank(ranks.average_rank(rows, "v", "c", "r"), "w", "c", "s"))
    upto = F.sum("w").over(by.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    assert both(ranks.running_within(rows, "c", "w", "id", frequent=frequent)) == both(rows.withColumn("upto", upto))


def test_numbered(rows):
    assert [r.id for r in ranks.numbered(rows.select("id"), F.desc("id")).orderBy("place").collect()] == list(range(900, -1, -1))
    assert ranks.numbered(rows.where("false"), F.col("id")).count() == 0


def test_frequent_class_spreads_over_tasks(spark):
    """A class with half of all rows is ranged with the others: no task's share is above twice the median."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("c"), F.xxhash64("id").alias("v"))
        heavy = ranks._ranged(rows.where("c = 0"), "c", "v")
        sizes = sorted(r.n for r in heavy.groupBy("_range").agg(F.count("*").alias("n")).collect())
        assert len(sizes) > 1 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_empty(rows):
    none = rows.where("false")
    assert ranks.average_rank(none, "v", "c").count() == ranks.place_within(none, "c", "id").count() == 0


@pytest.mark.parametrize("frequent", [50, 10**6])
def test_folds_do_not_depend_on_the_bound(rows, frequent):
    df = rows.where("c IS NOT NULL").withColumnsRenamed({"c": "class_idx", "v": "group_id"}).where("group_id IS NOT NULL")
    assert both(split.stratified_kfold(df, 3, frequent=frequent)) == both(split.stratified_kfold(df, 3))
    assert both(split.split_quota(df, frequent=2 if frequent == 50 else frequent)) == both(split.split_quota(df))


def test_sampled_check(rows):
    found = audit.sampled_check(rows, "c", "id", F.col("v") > 5).first()
    first = {}
    for r in sorted(rows.collect()):
        first.setdefault(r.c, []).append(r.v)
    assert found.classes == 5 and found.images == 901
    assert found.unreadable == sum(v <= 5 for vs in first.values() for v in vs[:5] if v is not None)
    assert audit.sampled_check(rows.where("false"), "c", "id", F.col("v") > 5).first().asDict() == {"classes": 0, "images": 0, "unreadable": 0}


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_quantiles_are_exact(spark, most):
    import numpy as np

    from lodeflow.operators import report

    draw = random.Random(6)
    rows = [(draw.choice([0.0, 1.0, 1.0, 5.5]), draw.gauss(0, 1) * 10 ** draw.randrange(9), draw.randrange(10**6), None, 7.0 if i else None) for i in range(5003)]
    df = spark.createDataFrame(rows, "a double, b double, c long, d double, e double").repartition(5)
    found = {r.name: tuple(r)[1:] for r in report.quantiles(df, list("abcde"), most).collect()}
    for i, name in enumerate("abce"):
        values = [r["abcde".index(name)] for r in rows if r["abcde".index(name)] is not None]
        assert np.allclose(found[name], np.quantile(values, report.QUARTILES), rtol=1e-12)
    assert found["d"] == (None,) * 5
    one = report.quantiles(df.where("e IS NULL"), ["b"], most).first()
    assert one.q0 == one.q50 == one.q100 == rows[0][1]


def test_quantiles_read_the_rows_twice(spark):
    """Rows are counted once and their values once, however many columns, quartiles and rows there are."""
    from lodeflow.operators import report

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(20000).select(F.xxhash64("id").alias("a"), (F.col("id") % 7).alias("b")).mapInArrow(seen, "a long, b long")
    found = {r.name: tuple(r)[1:] for r in report.quantiles(df, ["a", "b"], 10).collect()}
    assert found["b"] == (0, 1, 3, 5, 6) and read.value <= 3 * 20000  # all for the counts, then once for each column


def test_tasks_do_not_grow_with_the_table(spark):
    """Windows over many small classes: partitions follow from the number of rows, ranks stay the same."""
    rows = spark.range(20000).select("id", (F.col("id") % 500).alias("c"), F.xxhash64("id").alias("v"), F.lit(1).alias("w"))
    for found in (ranks.average_rank(rows, "v", "c", task_rows=1000), ranks.place_within(rows, "c", "v", name="r", task_rows=1000), ranks.running_within(rows, "c", "w", "v", name="r", task_rows=1000)):
        assert found.rdd.getNumPartitions() == 20
    assert both(ranks.average_rank(rows, "v", "c", task_rows=1000)) == both(ranks.average_rank(rows, "v", "c"))
