"""Places and ranks in two levels: within ranges of the order, then over the ranges' counts. No task holds a frequent class.

A class of at most `frequent` rows is ranked by one window. Rows of a larger class are range-partitioned by (class,
order); each range counts for itself and learns from the ranges' counts, a small table, what lies before it. Both give
the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodeflow.session import materialize, shuffle_width

#: Rows of a class that one window ranks in one task.
FREQUENT = 1_000_000
_ORDINAL = (1 << 33) - 1  # the low bits of monotonically_increasing_id: a row's place in its partition


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with name: each row's place from 0 in the order of all rows. Rows equal in order get places in any order among themselves.

    Rows move once, to ranges of the order; the table of ranges' sizes has a row for each partition and is broadcast.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_ORDINAL)).alias("_at")))
    before = _before(placed.groupBy("_range").agg(F.count("*").alias("_n")), [])
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before", "_n", "_total")


def _before(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """ranges (keys, _range, _n) with _before, what the ranges of the same keys ahead hold, and _total, what all of them hold."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy()
    ahead = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn("_total", F.sum("_n").over(own))


#: Rows that one task sorts, about.
TASK_ROWS = 1_000_000


def _by_class(df: DataFrame, key: str, most: int) -> tuple[DataFrame | None, int]:
    """The values of key with more than most rows, or None without any, and the number of all rows."""
    seen = Observation()
    sizes = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).observe(seen, F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
    found = materialize(sizes.where(F.col("_n") > most).select("_key"))
    return (None if found.isEmpty() else found), seen.get["rows"]


def frequent_classes(df: DataFrame, key: str, most: int = FREQUENT) -> DataFrame | None:
    """The values of key with more than most rows, or None without any. One in most rows at most, so the table is small."""
    return _by_class(df, key, most)[0]


def _dealt(df: DataFrame, key: str, rows: int, task_rows: int) -> DataFrame:
    """df with classes whole, in tasks of about task_rows rows at most: a task's memory does not grow with the table.

    The number is given, so that small partitions, which compressed look smaller than what a sort holds, are not put together.
    """
    return df.repartition(max(-(-rows // task_rows), shuffle_width(df.sparkSession)), key) if rows > task_rows else df


def _split(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(heavy, same, "left_anti"), df.join(heavy, same, "left_semi")


def _ranged(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return materialize(df.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id()))


def _with_before(ranged: DataFrame, key: str, weight: Column) -> DataFrame:
    """ranged with _before and _total of its key; a range and key are met in full by one row of the ranges' table."""
    ranges = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.sum(weight).alias("_n")).withColumnRenamed("_of", "_range")
    ranges = _before(ranges, ["_key"]).withColumnRenamed("_range", "_of").drop("_n")
    return ranged.join(ranges, ranged[key].eqNullSafe(ranges["_key"]) & (ranged["_range"] == ranges["_of"])).drop("_key", "_of")


def place_within(df: DataFrame, key: str, *order: Column | str, name: str = "place", frequent: int = FREQUENT, task_rows: int = TASK_ROWS) -> DataFrame:
    """df with name: each row's place from 0 within its class, in order. Null classes are one class."""
    window = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    heavy, rows = _by_class(df, key, frequent)
    if heavy is None:
        return _dealt(df, key, rows, task_rows).withColumn(name, window(key))
    light, large = _split(df, key, heavy)
    light = _dealt(light, key, rows, task_rows)
    placed = _with_before(_ranged(large, key, *order), key, F.lit(1))
    placed = placed.withColumn(name, F.col("_before") + window("_range", key)).drop("_range", "_before", "_total")
    return light.withColumn(name, window(key)).unionByName(placed)


def running_within(df: DataFrame, key: str, weight: str, *order: Column | str, name: str = "upto", frequent: int = FREQUENT, task_rows: int = TASK_ROWS) -> DataFrame:
    """df with name: the sum of weight over the rows of its class up to its own, in order; order tells all rows of a class apart."""
    window = lambda *keys: F.sum(weight).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    heavy, rows = _by_class(df, key, frequent)
    if heavy is None:
        return _dealt(df, key, rows, task_rows).withColumn(name, window(key))
    light, large = _split(df, key, heavy)
    light = _dealt(light, key, rows, task_rows)
    placed = _with_before(_ranged(large, key, *order), key, F.col(weight))
    placed = placed.withColumn(name, F.col("_before") + window("_range", key)).drop("_range", "_before", "_total")
    return light.withColumn(name, window(key)).unionByName(placed)


def average_rank(df: DataFrame, value: str, key: str, name: str = "r", frequent: int = FREQUENT, task_rows: int = TASK_ROWS) -> DataFrame:
    """df with name: the average rank of value within its class, see average_ranks."""
    return average_ranks(df, {value: name}, key, frequent, task_rows)


def average_ranks(df: DataFrame, names: dict[str, str], key: str, frequent: int = FREQUENT, task_rows: int = TASK_ROWS) -> DataFrame:
    """df with a column for each value of names: its average rank within the class, scaled to 0 .. 1; 0.5 for a class of one row.

    Nulls rank first. In a frequent class equal values are counted first, so what is ranged are distinct values, and rows
    that tie over several ranges cannot occur; the ranks meet the rows by (class, value) again. df is read more than once.
    """
    scaled = lambda rank0, n: F.when(n <= 1, F.lit(0.5)).otherwise(rank0 / (n - 1))
    by_class = Window.partitionBy(key)

    def windowed(rows: DataFrame) -> DataFrame:
        for value, name in names.items():
            rank0 = F.rank().over(by_class.orderBy(value)) - 1 + (F.count("*").over(Window.partitionBy(key, value)) - 1) / F.lit(2.0)
            rows = rows.withColumn(name, scaled(rank0, F.count("*").over(by_class)))
        return rows

    heavy, n_rows = _by_class(df, key, frequent)
    if heavy is None:
        return windowed(_dealt(df, key, n_rows, task_rows))
    light, large = _split(df, key, heavy)
    light = _dealt(light, key, n_rows, task_rows)
    met = large
    for value, name in names.items():
        counts = large.groupBy(F.col(key).alias("_class"), F.col(value).alias("_value")).agg(F.count("*").alias("_m"))
        placed = _with_before(_ranged(counts, "_class", "_value"), "_class", F.col("_m"))
        ahead = F.sum("_m").over(Window.partitionBy("_range", "_class").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1))
        rank0 = F.col("_before") + F.coalesce(ahead, F.lit(0)) + (F.col("_m") - 1) / F.lit(2.0)
        ranked = placed.select("_class", "_value", scaled(rank0, F.col("_total")).alias(name))
        met = met.join(ranked, met[key].eqNullSafe(ranked["_class"]) & met[value].eqNullSafe(ranked["_value"])).drop("_class", "_value")
    return windowed(light).unionByName(met)
