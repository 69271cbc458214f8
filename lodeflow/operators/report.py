"""Reports: counts, quantiles, correlations, accuracy, training progress."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.session import materialize

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, classes: DataFrame, key: str = "class_idx") -> DataFrame:
    """n for every class of classes, 0 for those without rows."""
    return classes.join(value_counts(df, key), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


#: Values of a column that one aggregate holds.
SELECT_ROWS = 1_000_000


def quantiles(df: DataFrame, columns: list[str], most: int = SELECT_ROWS) -> DataFrame:
    """A row for each column with its exact quartiles, interpolated; nulls are left out, a column without values has nulls.

    A column of at most `most` values is one aggregate. Values of the others are counted, and the distinct ones ranged by
    (column, value) with their counts: one shuffle of distinct values, however many columns and quartiles there are. The
    ranges' counts say in which range a wanted rank lies, and only these few values pass the driver.
    """
    first = df.agg(*(F.count(c).alias(f"n_{i}") for i, c in enumerate(columns))).first()
    few = {i: c for i, c in enumerate(columns) if 0 < first[f"n_{i}"] <= most}  # so few that one task may hold them
    plain = df.agg(*(F.percentile(c, F.array(*map(F.lit, QUARTILES))).alias(f"q_{i}") for i, c in few.items())).first() if few else None
    wanted = {i: sorted({r for q in QUARTILES for r in _ranks(q, first[f"n_{i}"])[:2]}) for i in range(len(columns)) if first[f"n_{i}"] > most}
    found = _picked(df, columns, wanted) if wanted else {}  # (column, rank from 0): value
    rows = []
    for i, c in enumerate(columns):
        values = list(plain[f"q_{i}"]) if i in few else []
        for q in QUARTILES if i not in few else ():
            if not first[f"n_{i}"]:
                values.append(None)
                continue
            a, b, part = _ranks(q, first[f"n_{i}"])
            low, high = found[i, a], found[i, b]
            values.append(low if part == 0 else low * (1 - part) + high * part)
        rows.append((c, *values))
    return df.sparkSession.createDataFrame(rows, "name string, " + ", ".join(f"q{int(q * 100)} double" for q in QUARTILES))


def _ranks(q: float, n: int) -> tuple[int, int, float]:
    """The two ranks from 0 between which the quantile q of n values lies, and where."""
    at = q * (n - 1)
    low = int(at)
    return low, min(low + (at > low), n - 1), at - low


def _picked(df: DataFrame, columns: list[str], wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The values of the wanted ranks (from 0) of columns: equal values are counted, and the running count says which one holds a rank."""
    counts = [df.where(F.col(columns[i]).isNotNull()).groupBy(F.col(columns[i]).cast("double").alias("v")).agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "v", "n") for i in wanted]
    ranged = materialize(reduce(DataFrame.unionByName, counts).repartitionByRange("i", "v").withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("i", "part").agg(F.sum("n").alias("own"))
    before = before.withColumn("before", F.sum("own").over(Window.partitionBy("i").orderBy("part")) - F.col("own"))
    asked = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(r).cast("long").alias("rank")) for i, ranks in wanted.items() for r in ranks))
    near = before.withColumn("asked", F.filter(asked, lambda a: (a["i"] == F.col("i")) & (a["rank"] >= F.col("before")) & (a["rank"] < F.col("before") + F.col("own")))).where(F.size("asked") > 0)
    upto = F.sum("n").over(Window.partitionBy("i", "part").orderBy("v"))
    placed = ranged.join(F.broadcast(near), ["i", "part"]).withColumn("upto", F.col("before") + upto)  # a few ranges
    met = placed.select("i", "v", F.explode(F.filter("asked", lambda a: (a["rank"] < F.col("upto")) & (a["rank"] >= F.col("upto") - F.col("n")))).alias("a"))
    return {(r.i, r.rank): r.v for r in met.select("i", "v", "a.rank").collect()}


def spread_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample standard deviation and count of value for each key."""
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r for each pair of columns, from one aggregate."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("p")).select("p.*")


def accuracy(df: DataFrame, pred: Column, label: Column) -> DataFrame:
    """One row: n and top-1 accuracy, 0 without rows."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.avg((pred == label).cast("double")), F.lit(0.0)).alias("accuracy"))


def early_stopping(history: DataFrame, patience: int, key: str | None = None) -> DataFrame:
    """history (epoch, acc) with best so far, improved, stale epochs since, and stopped.

    Only a value strictly above the best before, 0 at first, is an improvement. Patience 0 never stops.
    """
    parts = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    order = parts.orderBy("epoch")
    before = F.coalesce(F.max("acc").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = F.greatest(before, F.lit(0.0))
    df = history.withColumn("improved", F.col("acc") > before).withColumn("best", F.greatest("acc", before))
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("epoch").over(parts)
    df = df.withColumn("stale", F.col("epoch") - F.coalesce(last, first - 1))
    return df.withColumn("stopped", F.lit(patience > 0) & (F.col("stale") >= patience))


def progress(log: DataFrame) -> DataFrame:
    """Last state of each stage in a log (line_no, line): done, total and rate, stages in the order of their first line.

    Lines say `[stage] done/total (rate img/s)`; others carry nothing.
    """
    shape = r"^\[(\w+)\]\s+(\d+)/(\d+)(?:\s+\(([\d.]+) img/s\))?"
    part = lambda i: F.regexp_extract("line", shape, i)
    found = log.where(F.col("line").rlike(shape)).select("line_no", part(1).alias("stage"), part(2).cast("bigint").alias("done"), part(3).cast("bigint").alias("total"), F.try_to_number(F.nullif(part(4), F.lit("")), F.lit("999999.99")).cast("double").alias("rate"))
    return found.groupBy("stage").agg(F.min("line_no").alias("first_line"), F.max_by("done", "line_no").alias("done"), F.max_by("total", "line_no").alias("total"), F.max_by("rate", "line_no").alias("rate"))


# The lines that an archive audit logs, a total for each stage and its progress.
AUDIT_TOTAL = r"\[(train|test)\]\s+.*?(\d+)\s*个文件"
AUDIT_PROGRESS = r"\[(train|test)\]\s+(\d+)/(\d+)\s+\(([\d.]+)%\)，可用\s+(\d+)，异常\s+(\d+)，([\d.]+)\s*张/秒"


def audit_states(log: DataFrame, order: str) -> DataFrame:
    """Last state of each stage in an audit's log (order, line), also a streaming one: stage, first (order), announced and state.

    announced is the last total that the log names, state the numbers of its last line of progress; either may be missing.
    """
    part = lambda shape, i: F.regexp_extract("line", shape, i)
    total, state = F.col("line").rlike(AUDIT_TOTAL), F.col("line").rlike(AUDIT_PROGRESS)
    names = ("done", "total", "percent", "usable", "anomalies", "rate")
    kinds = ("bigint", "bigint", "double", "bigint", "bigint", "double")
    values = F.struct(*(part(AUDIT_PROGRESS, i + 2).cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))))
    found = log.where(total | state).select(
        order,
        F.when(state, part(AUDIT_PROGRESS, 1)).otherwise(part(AUDIT_TOTAL, 1)).alias("stage"),
        F.when(total, part(AUDIT_TOTAL, 2).cast("bigint")).alias("announced"),
        F.when(state, values).alias("state"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return found.groupBy("stage").agg(F.min(order).alias("first"), last("announced"), last("state"))


def audit_progress(log: DataFrame) -> DataFrame:
    """Last state of each stage in an audit's log (line_no, line): stage, first_line, announced, done, total, percent, usable,
    anomalies and rate. A stage with a total only has nulls in what follows it.
    """
    return audit_states(log, "line_no").select("stage", F.col("first").alias("first_line"), "announced", "state.*")


def audit_share(states: DataFrame) -> DataFrame:
    """One row: what is done of all announced totals; null without any."""
    return states.agg((F.coalesce(F.sum("done"), F.lit(0)) / F.nullif(F.sum("announced"), F.lit(0))).alias("share"))


def overall(states: DataFrame) -> DataFrame:
    """One row: done over total of all stages."""
    return states.agg(F.coalesce(F.sum("done") / F.sum("total"), F.lit(0.0)).alias("share"))
