"""Head and tail classes, group-aware folds and weighted sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.scalars import seeded_bucket, seeded_uniform
from lodeflow.operators import ranks
from lodeflow.operators.dedup import dense_ids
from lodeflow.session import materialize


def class_parts(df: DataFrame, head: float = 0.33, tail: float = 0.33, key: str = "class_idx") -> DataFrame:
    """class_idx, n and part of each class of the rows outside the fold val, classes ascending by size.

    The last floor(C * head) classes are head, the first floor(C * tail) tail, the rest middle; where they
    overlap, head wins. Ties in size go by class_idx. Classes are few: they are ranked in one task.
    """
    sizes = df.where("fold IS NULL OR fold <> 'val'").groupBy(key).agg(F.count("*").alias("n"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = sizes.withColumn("place", F.row_number().over(Window.orderBy("n", key))).withColumn("c", F.count("*").over(every))
    part = F.when(F.col("place") > F.col("c") - F.floor(F.col("c") * head), "head").when(F.col("place") <= F.floor(F.col("c") * tail), "tail").otherwise("middle")
    return place.select(key, "n", part.alias("part"))


def assign_parts(df: DataFrame, head: float = 0.33, tail: float = 0.33, key: str = "class_idx") -> DataFrame:
    """df with part; classes without rows outside val are middle."""
    parts = class_parts(df, head, tail, key).select(key, "part")
    return df.join(parts, key, "left").withColumn("part", F.coalesce("part", F.lit("middle")))


def contingency(df: DataFrame, group: str = "group_id", key: str = "class_idx") -> DataFrame:
    return df.groupBy(group, key).agg(F.count("*").alias("n"))


def group_kfold(df: DataFrame, folds: int, seed: int = 42, group: str = "group_id") -> DataFrame:
    """df with fold_no from the hash of its group, so no group spans folds."""
    return df.withColumn("fold_no", seeded_bucket(F.col(group), seed, folds))


def stratified_kfold(df: DataFrame, folds: int, seed: int = 42, key: str = "class_idx", id_col: str = "id", frequent: int = ranks.FREQUENT) -> DataFrame:
    """df with fold_no: rows of a class, in an order given by the hash of their id, are dealt to the folds in turn."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    placed = ranks.place_within(df, key, order, F.col(id_col), name="_place", frequent=frequent)
    return placed.withColumn("fold_no", F.pmod("_place", F.lit(folds)).cast("int")).drop("_place")


def split_quota(df: DataFrame, val_ratio: float = 0.1, least: int = 10, folds: int = 3, seed: int = 42, frequent: int = ranks.FREQUENT) -> DataFrame:
    """df (group_id, class_idx) with fold, without any sequential step.

    A group's class is its most frequent one (ties: the smallest). Within a class of at least least rows, groups
    in hash order are val while their running size stays within max(1, floor(n * val_ratio)); other groups of
    such a class are train. Groups of smaller classes are dealt to oof_0 ... by their hash. No group spans folds.
    """
    counts = materialize(contingency(df))
    sizes = counts.groupBy("class_idx").agg(F.sum("n").alias("class_n"))
    main = counts.groupBy("group_id").agg(F.max_by("class_idx", F.struct("n", -F.col("class_idx"))).alias("class_idx"), F.sum("n").alias("size"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("group_id").cast("string")))
    main = ranks.running_within(materialize(main), "class_idx", "size", order, F.col("group_id"), name="run", frequent=frequent).join(sizes, "class_idx")
    run = F.col("run")
    quota = F.greatest(F.lit(1), F.floor(F.col("class_n") * val_ratio))
    small = F.concat(F.lit("oof_"), seeded_bucket(F.col("group_id"), seed, folds).cast("string"))
    fold = F.when(F.col("class_n") < least, small).when(run <= quota, "val").otherwise("train")
    return df.join(main.select("group_id", fold.alias("fold")), "group_id")


#: Groups that split_greedy takes at most: its rule is one pass in order, held by the driver.
GREEDY_GROUPS = 5_000_000


def greedy_folds(groups: list[tuple[int, list[tuple[int, int]]]], val_ratio: float, least: int, folds: int, seed: int) -> list[tuple[int, str]]:
    """The fold of each group (number, counts by class); groups come in the order of their numbers."""
    totals: dict[int, int] = {}
    for _, counts in groups:
        for c, n in counts:
            totals[c] = totals.get(c, 0) + n
    missing = {c: max(1, int(n * val_ratio)) for c, n in totals.items() if n >= least}  # rows that val still wants of a class
    load = {c: [0] * folds for c in totals if c not in missing}
    rng, found = random.Random(seed), []
    order = list(range(len(groups)))
    rng.shuffle(order)
    for g in order:
        number, counts = groups[g]
        wanted = [(c, n) for c, n in counts if c in missing]
        if wanted:
            closer = sum(abs(missing[c]) - abs(missing[c] - n) for c, n in wanted) > 0
            for c, n in wanted if closer else ():
                missing[c] -= n
            found.append((number, "val" if closer else "train"))
        else:
            ties = list(range(folds))
            rng.shuffle(ties)
            fold = min(ties, key=lambda k: sum(load[c][k] for c, _ in counts))
            for c, n in counts:
                load[c][fold] += n
            found.append((number, f"oof_{fold}"))
    return found


def split_greedy(df: DataFrame, val_ratio: float = 0.1, least: int = 10, folds: int = 3, seed: int = 42, groups_at_most: int = GREEDY_GROUPS) -> DataFrame:
    """df (group_id, class_idx) with fold by the sequential rule over groups in a seeded random order.

    A group that touches a class of least rows or more is val if that strictly lowers the sum over these classes
    of |val - target|, target = max(1, int(n * val_ratio)), and train otherwise. Other groups go to the one of
    oof_0 ... that holds the fewest rows of the group's own classes, ties in a random order of their own. Rows
    without a group have no fold. The rule needs one pass in order, so the table of groups and classes passes the
    driver: above groups_at_most groups this raises ValueError, and so do fewer than two folds. split_quota is another
    rule without such a pass; nothing changes to it by itself.
    """
    if folds < 2:
        raise ValueError("at least two folds are needed")
    table = contingency(df).where("group_id IS NOT NULL").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("class_idx", "n"))).alias("counts"))
    n_groups = table.count()
    if n_groups > groups_at_most:
        raise ValueError(f"{n_groups} groups are more than the sequential rule takes ({groups_at_most}); split_quota has no such bound")
    groups = [(r.group_id, [(c.class_idx, c.n) for c in r.counts]) for r in table.orderBy("group_id").toLocalIterator()]
    found = greedy_folds(groups, val_ratio, least, folds, seed)
    return df.join(df.sparkSession.createDataFrame(found, "group_id bigint, fold string"), "group_id", "left")


def epoch_order(df: DataFrame, seed: int, epoch: int, key: str = "id") -> DataFrame:
    """df with position: its rows' order from 0 in one epoch, a shuffle that the seed, the epoch and the key decide.

    Positions are counted in ranges of the shuffle's hash, so no task holds all rows. Equal keys get one position.
    """
    mixed = F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")))
    ranked = dense_ids(df.select(key).distinct().withColumn("_mixed", F.struct(mixed.alias("h"), F.col(key).alias("k"))), "_mixed", "position")
    return df.join(ranked.select(key, "position"), key)


def weighted_sample(df: DataFrame, weight: str, draws: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """draw and id of draws rows taken with replacement, in proportion to weight, whatever the partitions.

    Row i is drawn as often as seeded points fall into its share of the running total of weights. Running totals
    are made within ranges of ids, and ranges' totals added up, so no task holds all rows.
    """
    ranged = df.where(F.col(weight) > 0).select(F.col(id_col).alias("id"), F.col(weight).cast("double").alias("w")).repartitionByRange("id").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged)
    own = F.sum("w").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy("part").agg(F.sum("w").alias("total"))
    before = sums.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = sums.agg(F.sum("total")).first()[0] or 0.0
    placed = ranged.withColumn("own", own).join(F.broadcast(before), "part").select("part", "id", (F.col("before") + F.col("own") - F.col("w")).alias("low"))
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (seeded_uniform(F.col("id"), seed) * F.lit(total)).alias("at"))
    points = points.join(F.broadcast(before), (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("total")))
    # a point belongs to the last row that begins at it or before it
    rows = placed.select("part", F.col("low").alias("at"), F.lit(0).alias("kind"), "id", F.lit(None).cast("bigint").alias("draw"))
    both = rows.unionByName(points.select("part", "at", F.lit(1).alias("kind"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "draw"))
    upto = Window.partitionBy("part").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("id", F.last("id", ignorenulls=True).over(upto)).where("kind = 1").select("draw", "id")
