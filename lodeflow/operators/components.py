"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeflow.session import materialize

#: Links that a task works on, about: some tens of MB.
TASK_LINKS = 1_000_000


def _roots(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some links and the smallest node that each reaches over these."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        lower = label.copy()
        np.minimum.at(lower, label[a], low)  # a label learns, and with it all that bear it
        np.minimum.at(lower, label[b], low)
        while not np.array_equal(lower, lower[lower]):
            lower = lower[lower]
        lower = lower[label]
        if np.array_equal(lower, label):
            return nodes, nodes[label]
        label = lower


def _forest(links: DataFrame, n: int, most: int) -> DataFrame:
    """Links x > y with the same components: tasks of about most of the n links hang every node directly on the smallest one it reaches there."""

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def stars() -> pa.RecordBatch:
            node, root = _roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            inner = node != root
            return pa.RecordBatch.from_arrays([pa.array(node[inner]), pa.array(root[inner])], names=["x", "y"])

        for batch in batches:
            held.append((batch.column("x").to_numpy(), batch.column("y").to_numpy()))
            rows += batch.num_rows
            if rows >= 2 * most:
                yield stars()
                held, rows = [], 0
        if held:
            yield stars()

    return links.coalesce(-(-n // most)).mapInArrow(hang, "x bigint, y bigint")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """node and component, the smallest node it is linked with directly or through others, for every linked node.

    Integer nodes. Tasks of about task_links links first shrink their own links to stars; where all links fit into one
    task, that is all. Otherwise each round contracts every node to the neighbour with the least random rank (its own
    included), drawn anew for the round, so that the links left shrink by a factor whatever the graph's shape and ids
    are; the contractions, followed in order, name a component. A round's tables are written to the shared folder: a
    lost executor costs that round only. Null ends and links of a node with itself carry nothing and are left out;
    repeated links count once; an empty table gives an empty one.
    """
    links = links.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    links = materialize(links)
    nodes = None
    for turn in range(most_rounds):
        n = links.count()
        if n:
            links = materialize(_forest(links, n, task_links))
        if nodes is None:
            nodes = links.select("x").unionByName(links.select(F.col("y").alias("x"))).distinct().select(F.col("x").alias("node"), F.col("x").alias("root"))
        if n <= task_links:  # the stars are whole components
            named = nodes.join(links.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("y", "root").alias("root"))
            if not turn:
                return named.withColumnRenamed("root", "component")
            named = materialize(named)
            least = materialize(named.groupBy("root").agg(F.min("node").alias("component")))
            return named.join(least, "root").select("node", "component")
        rank = F.struct(F.xxhash64("y", F.lit(turn)).alias("rank"), F.col("y").alias("node"))
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy("x").agg(F.min(rank).alias("near")).select("x", F.least("near", F.struct(F.xxhash64("x", F.lit(turn)).alias("rank"), F.col("x").alias("node")))["node"].alias("to"))
        near = materialize(near)
        moved = links.join(near, "x").select("y", F.col("to").alias("a")).join(near.withColumnRenamed("x", "y"), "y").select(F.col("a").alias("x"), F.col("to").alias("y"))
        links = materialize(moved.where("x <> y").distinct())
        nodes = materialize(nodes.join(near.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
