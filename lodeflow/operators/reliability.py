"""Label reliability: prototypes, out-of-fold and leave-one-out signals, mutual neighbours, fusion.

Features are (id, y, g, z): row id, class, duplicate group and a unit vector of doubles. Signals are rounded to six
places before they are ranked, so engines that add up in another order agree on ties.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.scalars import negative_log, shrinkage
from lodeflow.functions.vectors import argmax, dot, l2_normalize, let, softmax, variance
from lodeflow.operators import ranks
from lodeflow.session import materialize

PLACES = 6
#: Numbers in the prototypes of all classes that each task may hold at most (128 MB).
MAX_PROTO_NUMBERS = 1 << 24


def vector_sum(df: DataFrame, keys: list[str], vector: str = "z", name: str = "s", n: str | None = None) -> DataFrame:
    """keys, n and the element-wise sum of a vector column. Whole vectors are added up in each task before anything is sent.

    n names a column of counts to add up, for sums of sums; without it rows are counted. Vectors of a key have one length.
    """
    added = Summarizer.metrics("sum").summary(array_to_vector(F.col(vector)))["sum"]
    counted = F.count("*") if n is None else F.sum(n)
    return df.groupBy(*keys).agg(counted.alias("n"), vector_to_array(added).alias(name))


def _minus(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x - y))


def _zeros(like: Column) -> Column:
    return F.transform(like, lambda _: F.lit(0.0))


def class_prototypes(df: DataFrame) -> DataFrame:
    """y, n and proto, the normalised mean vector, of each class that has rows."""
    return vector_sum(df, ["y"]).select("y", "n", l2_normalize(F.transform("s", lambda x: x / F.col("n"))).alias("proto"))


def packed_protos(proto: str, most: int = MAX_PROTO_NUMBERS) -> Column:
    """The aggregate protos: structs of y and proto in the order of y, for broadcast; an error if they hold more than most numbers."""
    numbers = F.coalesce(F.sum(F.size(proto)), F.lit(0))
    packed = F.array_sort(F.collect_list(F.struct("y", proto)))
    return F.when(numbers <= most, packed).otherwise(F.raise_error(F.concat(F.lit("prototypes too large to broadcast: "), numbers, F.lit(" numbers")))).alias("protos")


def cosine_logits(df: DataFrame, protos: DataFrame, scale: float = 20.0) -> DataFrame:
    """df with classes and logits, arrays in the order of the class. The prototypes are broadcast as one row of bounded size."""
    packed = protos.agg(packed_protos("proto"))
    logits = let(l2_normalize(F.col("z")), lambda unit: F.transform("protos", lambda p: dot(unit, p["proto"]) * scale))
    return df.join(F.broadcast(packed)).select("*", F.transform("protos", lambda p: p["y"]).alias("classes"), logits.alias("logits")).drop("protos")


def predicted(df: DataFrame) -> DataFrame:
    """df (classes, logits) with pred, the class of the largest logit, the first on a tie."""
    return df.withColumn("pred", F.get("classes", argmax(F.transform("logits", lambda x: F.round(x, 9)))))


def oof_signal(df: DataFrame, folds: int = 3, fold: str = "fold_no", scale: float = 20.0) -> DataFrame:
    """id, cls (probability of the own label under prototypes of the other folds) and loss.

    The other folds' class sums are total minus fold. A class without rows there has a zero prototype, which is
    decided on the count, and stays in the softmax with logit 0.
    """
    per = materialize(vector_sum(df, [fold, "y"]))  # classes by folds: small by construction, and the totals are made of it
    total = vector_sum(per, ["y"], "s", "t", "n").withColumnRenamed("n", "tn")
    grid = total.crossJoin(per.select(fold).distinct())
    rest = grid.join(per, [fold, "y"], "left").select(
        fold,
        "y",
        F.when(F.col("tn") - F.coalesce("n", F.lit(0)) > 0, l2_normalize(F.transform(_minus(F.col("t"), F.col("s")), lambda x: x / (F.col("tn") - F.coalesce("n", F.lit(0)))))).otherwise(_zeros(F.col("t"))).alias("proto"),
    )
    packed = rest.groupBy(fold).agg(packed_protos("proto"))
    logits = let(l2_normalize(F.col("z")), lambda unit: F.transform("protos", lambda p: dot(unit, p["proto"]) * scale))
    place = (F.array_position(F.transform("protos", lambda p: p["y"]), F.col("y")) - 1).cast("int")
    met = df.join(F.broadcast(packed), fold).select("id", F.get(softmax(logits), place).alias("own"))
    own = F.col("own")
    return met.select("id", F.round(own, PLACES).alias("cls"), F.round(negative_log(own), PLACES).alias("loss"))


def prototype_signal(df: DataFrame, tau: float = 10.0) -> DataFrame:
    """id and proto: cosine with the own class's prototype without the own group, minus the best rival class's.

    Prototypes shrink towards the global mean g: norm(r * norm(S) + (1 - r) * g), r = n / (n + tau) with the full
    class size. Without rows left of its class, a row is held against g.
    """
    total = materialize(vector_sum(df, ["y"], name="t").withColumnRenamed("n", "tn"))
    grouped = vector_sum(df, ["g", "y"]).withColumnRenamed("n", "gn")
    mean = vector_sum(total.withColumn("one", F.lit(1)), ["one"], "t", "s", "tn").select(l2_normalize(F.transform("s", lambda x: x / F.col("n"))).alias("g0"))
    ratio = shrinkage(F.col("tn"), tau)

    def shrunk(s: Column) -> Column:
        return l2_normalize(let(ratio, lambda r: F.zip_with(l2_normalize(s), F.col("g0"), lambda a, b: r * a + (1 - r) * b)))

    classes = total.join(F.broadcast(mean)).withColumn("own", shrunk(F.col("t")))
    packed = classes.agg(packed_protos("own"))
    # the table of classes is as long as packed, whose size is checked
    met = df.join(F.broadcast(classes.drop("own")), "y").join(grouped, ["g", "y"]).join(F.broadcast(packed))
    left = F.when(F.col("tn") - F.col("gn") > 0, shrunk(_minus(F.col("t"), F.col("s")))).otherwise(F.col("g0"))
    others = F.filter("protos", lambda p: p["y"] != F.col("y"))
    margin = let(l2_normalize(F.col("z")), lambda unit: dot(unit, left) - F.coalesce(F.array_max(F.transform(others, lambda p: dot(unit, p["own"]))), F.lit(0.0)))
    return met.select("id", F.round(margin, PLACES).alias("proto"))


#: Rows that one block of the neighbour search holds, about, and blocks of a stripe of queries and of neighbours.
BLOCK_ROWS, QUERY_BLOCKS, NEIGHBOUR_BLOCKS = 2048, 16, 32
#: Queries that are compared at once, and the most neighbours that they meet at once.
_QUERIES, _TILE = 256, 8192


def _nearest(left: np.ndarray, right: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of left: places in left, ids and cos (rounded to nine places) of the k nearest unit vectors of right; ties go to the smaller id.

    Single precision says which pairs can be among the k nearest of those met so far, within its bound of error; these
    few alone are worked out in double precision and sorted. Tiles grow as the k-th nearest of a query becomes known.
    """
    error = 2 * ((left.shape[1] + 4) * 2.0**-23)
    small_left, small_right = left.astype(np.float32), right.astype(np.float32)
    parts = []
    for at in range(0, len(left), _QUERIES):
        some, few = left[at : at + _QUERIES], small_left[at : at + _QUERIES]
        row, cos, nbr = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        least, low, size = np.full(len(some), -np.inf), 0, 512
        while low < len(right):
            near = few @ small_right[low : low + size].T
            if not low and near.shape[1] > k:
                known = np.where(np.isnan(near), np.float32(-np.inf), near)
                least = np.partition(known, -k, axis=1)[:, -k].astype(np.float64)
            hit_row, hit = np.nonzero(~(near < (least - error).astype(np.float32)[:, None]))  # values that are no number stay in
            if 32 * len(hit) > near.size:
                exact = (some @ right[low : low + size].T)[hit_row, hit]
            else:
                exact = np.einsum("ij,ij->i", some[hit_row], right[low + hit])
            row, cos, nbr = np.concatenate([row, hit_row]), np.concatenate([cos, np.round(exact, 9)]), np.concatenate([nbr, ids[low + hit]])
            order = np.lexsort((nbr, -cos, row))
            row, cos, nbr = row[order], cos[order], nbr[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kth = place == k - 1
            least[row[kth]] = cos[kth]
            row, cos, nbr = (x[place < k] for x in (row, cos, nbr))
            low, size = low + size, min(2 * (low + size), _TILE)
        parts.append((row + at, nbr, cos))
    row, nbr, cos = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, nbr, cos


def knn(df: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id, nbr, cos and rank (from 1) of the k nearest rows of every row by cosine, the row itself among them.

    Every row is a query, so all vectors meet all. Rows are packed into blocks and blocks into stripes; each stripe of
    queries meets each stripe of neighbours in one cell of a grid, so a vector is sent once for each stripe and not for
    each block, and a cell keeps k of each query. Ties in cos, rounded to nine places, go to the smaller id.
    """
    blocks = max(1, -(-df.count() // block_rows))
    columns = -(-blocks // NEIGHBOUR_BLOCKS)
    # narrower stripes of queries where the grid has fewer cells than would keep all cores busy
    rows = max(-(-blocks // QUERY_BLOCKS), min(blocks, -(-2 * df.sparkSession.sparkContext.defaultParallelism // columns)))
    unit = df.select("id", l2_normalize(F.col("z")).alias("z"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        vectors = table.column("z").combine_chunks()
        z = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table({"block": table.column("block")[:1], "ids": pa.array([table.column("id").to_numpy().tobytes()]), "zs": pa.array([z.tobytes()])})

    packed = materialize(unit.groupBy("block").applyInArrow(pack, "block int, ids binary, zs binary"))  # both sides are made of it
    own = lambda n: F.pmod("block", F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = packed.select(own(rows).alias("row"), every(columns).alias("column"), F.lit(True).alias("query"), "ids", "zs")
    offered = packed.select(every(rows).alias("row"), own(columns).alias("column"), F.lit(False).alias("query"), "ids", "zs")

    def near(table: pa.Table) -> pa.Table:
        def side(query: bool) -> tuple[np.ndarray, np.ndarray]:
            some = table.filter(pc.equal(table.column("query"), query))
            ids, zs = ([np.frombuffer(x.as_buffer(), t) for x in some.column(c)] for c, t in (("ids", np.int64), ("zs", np.float64)))
            ids = np.concatenate([np.zeros(0, np.int64), *ids])
            return ids, np.concatenate([np.zeros(0), *zs]).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))

        (asked_ids, left), (ids, right) = side(True), side(False)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(asked_ids) and len(ids):
            found = _nearest(left, right, ids, k)
        return pa.table({"id": pa.array(asked_ids[found[0]]), "nbr": pa.array(found[1]), "cos": pa.array(found[2])})

    met = asked.unionByName(offered).groupBy("row", "column").applyInArrow(near, "id bigint, nbr bigint, cos double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "nbr"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


def mutual(edges: DataFrame) -> DataFrame:
    """The edges (id, nbr, cos) whose reverse is an edge, too."""
    back = edges.select(F.col("id").alias("nbr"), F.col("nbr").alias("id"))
    return edges.join(back, ["id", "nbr"], "left_semi")


def mutual_knn_signal(df: DataFrame, k: int = 20) -> DataFrame:
    """id and knn: the share of the own label among mutual neighbours, weighted by max(cos, 0); 0 without any.

    Of the k + 1 nearest, self and rows of the own group are left out and not replaced.
    """
    info = df.select("id", "y", "g")
    edges = knn(df, k + 1).where("id <> nbr").join(info, "id").join(info.select(F.col("id").alias("nbr"), F.col("y").alias("ny"), F.col("g").alias("ng")), "nbr").where("NOT (g <=> ng)")
    weight = F.greatest("cos", F.lit(0.0))
    agreed = mutual(edges).groupBy("id").agg((F.sum(F.when(F.col("y") == F.col("ny"), weight).otherwise(0.0)) / (F.sum(weight) + 1e-8)).alias("knn"))
    return info.join(agreed, "id", "left").select("id", F.round(F.coalesce("knn", F.lit(0.0)), PLACES).alias("knn"))


def rank_within_class(df: DataFrame, value: str, key: str = "y", name: str = "r", frequent: int = ranks.FREQUENT) -> DataFrame:
    """df with the average rank of value within its class, scaled to 0 .. 1; 0.5 for a class of one row (see ranks.average_rank)."""
    return ranks.average_rank(df, value, key, name, frequent)


def fuse_q0(df: DataFrame, weights: dict[str, float], conflict: float = 0.1, low: float = 0.0, key: str = "y") -> DataFrame:
    """df with q0: the weighted mean of the signals' ranks within their class, less conflict times their variance, clipped to low .. 1.

    weights names the signals; one without a weight counts 1.
    """
    if not weights:
        raise ValueError("no signal to fuse")
    ranked = ranks.average_ranks(df, {name: f"r_{name}" for name in weights}, key)
    each = [F.col(f"r_{n}") for n in weights]
    mean = sum((r * w for r, w in zip(each, weights.values(), strict=True)), F.lit(0.0)) / sum(weights.values())
    spread = variance(F.array(*each)) if len(each) > 1 else F.lit(0.0)
    return ranked.withColumn("q0", F.least(F.greatest(mean - conflict * spread, F.lit(low)), F.lit(1.0))).drop(*(f"r_{n}" for n in weights))


def tail_protection(df: DataFrame, least: float = 5.0, key: str = "y", q: str = "q0") -> DataFrame:
    """df with q raised evenly in classes whose sum of q is below least, and clipped to 0 .. 1."""
    by_class = Window.partitionBy(key)
    mass, n = F.sum(q).over(by_class), F.count("*").over(by_class)
    lifted = F.when(mass < least, F.col(q) + (F.lit(least) - mass) / n).otherwise(F.col(q))
    return df.withColumn(q, F.least(F.greatest(lifted, F.lit(0.0)), F.lit(1.0)))


def compute_q0(df: DataFrame, weights: dict[str, float] | None = None, folds: int = 3, k: int = 20) -> DataFrame:
    """id, y, cls, proto, knn, loss and q0 of features with fold_no: all signals, fused, tails protected."""
    weights = weights or {"cls": 1.0, "proto": 1.0, "knn": 1.0}
    wide = df.select("id", "y").join(oof_signal(df, folds), "id").join(prototype_signal(df), "id").join(mutual_knn_signal(df, k), "id")
    return tail_protection(fuse_q0(materialize(wide), weights))


#: Steps of the mixture's fit, and the least variance of a part.
EM_STEPS, EM_FLOOR = 25, 1e-6


def _log_parts(v: Column, fit: tuple[float, float, float, float, float]) -> tuple[Column, Column]:
    """Log density, but for a constant, of both parts (weight of the first, means, variances) at v."""
    w, m1, s1, m2, s2 = fit
    part = lambda weight, mean, var: F.lit(math.log(weight) - 0.5 * math.log(var)) - (v - F.lit(mean)) * (v - F.lit(mean)) / F.lit(2 * var)
    return part(w, m1, s1), part(1 - w, m2, s2)


def _posterior(v: Column, fit: tuple) -> Column:
    a, b = _log_parts(v, fit)
    return F.lit(1.0) / (1 + F.exp(F.least(F.greatest(b - a, F.lit(-700.0)), F.lit(700.0))))


def fit_mixture(counts: DataFrame, steps: int = EM_STEPS) -> tuple[float, float, float, float, float]:
    """The likeliest of three fits of two normal parts to counts (v, n): weight of the first part, then mean and variance of each.

    Expectation-maximisation from fixed starts (least and greatest value; one deviation around the mean; mean and greatest);
    a step is one aggregate of sufficient statistics for all three, of which the driver sees nine sums.
    """
    n, low, high, mean, square = counts.agg(F.sum("n"), F.min("v"), F.max("v"), F.sum(F.col("n") * F.col("v")) / F.sum("n"), F.sum(F.col("n") * F.col("v") * F.col("v")) / F.sum("n")).first()
    var = max(square - mean * mean, EM_FLOOR)
    fits = [(0.5, m1, var, m2, var) for m1, m2 in ((low, high), (mean - math.sqrt(var), mean + math.sqrt(var)), (mean, high))]
    total = (float(n), n * mean, n * square)
    for _ in range(steps):
        sums = []
        for i, fit in enumerate(fits):
            r = F.col("n") * _posterior(F.col("v"), fit)
            sums += [F.sum(r).alias(f"r{i}"), F.sum(r * F.col("v")).alias(f"x{i}"), F.sum(r * F.col("v") * F.col("v")).alias(f"q{i}")]
        told = counts.agg(*sums).first()
        for i in range(len(fits)):
            parts = []
            for r, x, q in ((told[3 * i], told[3 * i + 1], told[3 * i + 2]), tuple(t - s for t, s in zip(total, told[3 * i : 3 * i + 3], strict=True))):
                r = max(r, 1e-9)
                parts += [x / r, max(q / r - (x / r) ** 2, EM_FLOOR)]
            fits[i] = (min(max(told[3 * i] / total[0], 1e-9), 1 - 1e-9), *parts)
    likely = []
    for fit in fits:
        a, b = _log_parts(F.col("v"), fit)
        likely.append(F.sum(F.col("n") * (F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))))
    scores = [round(x, 4) for x in counts.agg(*likely).first()]
    return fits[scores.index(max(scores))]


def gmm_signal(df: DataFrame, value: str = "loss", least: int = 100, gain: float = 0.05, steps: int = EM_STEPS) -> DataFrame | None:
    """id and gmm, the posterior of the part of low values of a mixture of two; None where the mixture says little.

    It says little with fewer than 2 * least rows, a hard cluster below least, or agreement with the split at the median of
    at most 0.5 + gain. Equal values are counted once for all steps (signals are rounded, so they are bounded in number).
    """
    rows = materialize(df.where(F.col(value).isNotNull()).select("id", F.col(value).cast("double").alias("v")))
    n = rows.count()
    if n < 2 * least:
        return None
    counts = materialize(rows.groupBy("v").agg(F.count("*").alias("n")))
    w, m1, s1, m2, s2 = fit_mixture(counts, steps)
    fit = (1 - w, m2, s2, m1, s1) if m2 < m1 else (w, m1, s1, m2, s2)
    scored = rows.select("id", "v", _posterior(F.col("v"), fit).alias("gmm"))
    middle = rows.agg(F.median("v")).first()[0]
    check = scored.agg(F.count_if(F.col("gmm") >= 0.5).alias("a"), F.avg(((F.col("gmm") >= 0.5) == (F.col("v") <= F.lit(middle))).cast("int")).alias("same")).first()
    if min(check.a, n - check.a) < least or check.same <= 0.5 + gain:
        return None
    return scored.select("id", "gmm")
