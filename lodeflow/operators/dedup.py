"""Exact and near duplicates: conflicts, weights, Hamming-radius joins and duplicate groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeflow.functions.scalars import SEGMENTS, hamming, segment
from lodeflow.operators.components import connected_components
from lodeflow.session import materialize


def hash_groups(df: DataFrame, key: str = "file_hash", label: str = "class_idx") -> DataFrame:
    """Rows and distinct labels of each non-null hash."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(label).alias("n_labels"))


def dup_groups(df: DataFrame, key: str = "file_hash") -> DataFrame:
    """Rows whose hash others share, with the group's size; null hashes are no duplicates."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("group_size")).where("group_size > 1")
    return df.join(sizes, key)


def conflict_mask(df: DataFrame, key: str = "file_hash", label: str = "class_idx") -> DataFrame:
    """df with conflict: whether its hash stands under two labels or more. Null hashes never conflict."""
    bad = hash_groups(df, key, label).where("n > 1 AND n_labels > 1").select(key, F.lit(True).alias("conflict"))
    return df.join(bad, key, "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


def drop_conflicts(df: DataFrame, key: str = "file_hash", label: str = "class_idx") -> DataFrame:
    bad = hash_groups(df, key, label).where("n > 1 AND n_labels > 1").select(key)
    return df.join(bad, key, "left_anti")


def dup_weight(df: DataFrame, key: str = "file_hash", label: str = "class_idx") -> DataFrame:
    """df with weight: 1 / size for rows of a hash group of one label, 1 for all others."""
    groups = hash_groups(df, key, label).where("n > 1 AND n_labels = 1").select(key, (F.lit(1.0) / F.col("n")).alias("weight"))
    return df.join(groups, key, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


#: The bits of each byte value as eight bytes of 0 or 1, read as one number: eight counters that add up at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)
_ADD = 255  # numbers that can be added before a counter of one byte is full


def _bit_counts(digests: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each of the (not empty) groups digests[bounds[i]:bounds[i + 1]] of 8 bytes, how many have each of the 64 bits."""
    blocks = -(-np.diff(bounds) // _ADD)
    ends = np.cumsum(blocks)
    starts = np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)
    starts = np.repeat(bounds[:-1], blocks) + starts * _ADD
    added = np.add.reduceat(_SPREAD[digests], starts, axis=0).view(np.uint8).reshape(-1, 64)
    return np.add.reduceat(added.astype(np.int64), ends - blocks, axis=0)


def simhash(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id and a 64-bit SimHash h over the distinct lower-cased words of text; null for texts without words.

    A bit is set where more words have it than not. A word's bits are the first 64 of its MD5, made once for all
    texts of a batch; the sums of bits are made in Arrow batches, some texts at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            found, known = [], {}
            for at in range(0, len(batch), 64):
                told = [set((text or "").lower().split()) if text is not None else set() for text in batch["text"].iloc[at : at + 64]]
                for word in set().union(*told).difference(known):
                    known[word] = hashlib.md5(word.encode()).digest()[:8]
                sizes = np.array([len(words) for words in told])
                hashes = np.zeros(len(told), np.int64)
                if sizes.any():
                    digests = np.frombuffer(b"".join([known[w] for words in told for w in words]), np.uint8).reshape(-1, 8)
                    counts = _bit_counts(digests, np.append(0, np.cumsum(sizes[sizes > 0])))
                    hashes[sizes > 0] = np.packbits(2 * counts > sizes[sizes > 0][:, None], axis=1).view(">i8").reshape(-1)
                found += [int(h) if n else None for h, n in zip(hashes, sizes, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "h": pd.array(found, dtype="Int64")})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id bigint, h bigint")


#: Fingerprints under one key above which a second segment tells them apart.
FULL = 50_000


def _flipped(number: int, flips: int) -> F.Column:
    """Segment number of h with each way to flip up to flips of its bits."""
    shift, width = SEGMENTS[number]
    masks = {sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(width), n)}
    key = segment(F.col("h"), shift, width)
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in sorted(masks)]), lambda m: F.struct(F.lit(number).alias("seg"), key.bitwiseXOR(m).alias("key")))


def _keys(df: DataFrame, flips: int) -> DataFrame:
    """A row for each segment of h and each way to flip up to flips of its bits."""
    return df.select("h", F.explode(F.concat(*(_flipped(i, flips) for i in range(len(SEGMENTS))))).alias("k")).select("h", "k.seg", "k.key")


def _second_keys(keyed: DataFrame, flips: int) -> DataFrame:
    """keyed with a row for each way to flip up to flips bits of another segment: seg2 and key2."""
    every = [_flipped(i, flips) for i in range(len(SEGMENTS))]
    other = F.when(F.col("seg") == 0, F.concat(every[1], every[2])).when(F.col("seg") == 1, F.concat(every[0], every[2])).otherwise(F.concat(every[0], every[1]))
    return keyed.select("h", "seg", "key", F.explode(other).alias("k")).select("h", "seg", "key", F.col("k.seg").alias("seg2"), F.col("k.key").alias("key2"))


def hamming_pairs(df: DataFrame, radius: int = 8, full: int = FULL) -> DataFrame:
    """Pairs of different 64-bit fingerprints h within radius: a < b and distance; radius is 0 to 8.

    Of three segments of two such fingerprints one differs in at most radius // 3 bits. Each side flips half of
    these bits, rounded up, so the two share a key: an equi-join instead of a comparison of all pairs. Where more than full
    fingerprints share a key, the other two segments have radius bits to differ in, so one of them differs in at most half
    of these; the same is done with it, and pairs meet by both keys. So a frequent segment (of very short texts, say) is
    no key by itself. Equal fingerprints are one here; join them back by value. Null fingerprints pair with nothing.
    """
    if not 0 <= radius <= 8:
        raise ValueError("radius is 0 to 8")
    distinct = materialize(df.where("h IS NOT NULL").select("h").distinct())
    keyed = _keys(distinct, -(-(radius // 3) // 2))

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        # by size of file Spark takes the few bytes of the fingerprints for those of all their keys, and would send these to every task
        pairs = rows.withColumnRenamed("h", "a").join(rows.withColumnRenamed("h", "b").hint("merge"), on)
        return pairs.where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= radius)).select("a", "b")

    crowded = None
    if distinct.count() > full:
        crowded = materialize(keyed.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > full).select("seg", "key"))
    if crowded is None or crowded.isEmpty():
        pairs = met(keyed, ["seg", "key"])
    else:
        pairs = met(keyed.join(crowded, ["seg", "key"], "left_anti"), ["seg", "key"])
        second = _second_keys(keyed.join(crowded, ["seg", "key"], "left_semi"), -(-(radius // 2) // 2))
        pairs = pairs.unionByName(met(second, ["seg", "key", "seg2", "key2"]))
    return pairs.distinct().withColumn("distance", hamming(F.col("a"), F.col("b")))


def build_groups(df: DataFrame, radius: int = 8) -> DataFrame:
    """df (id, file_hash, h) with group_id: components of equal hashes and fingerprints within radius, across labels.

    Groups are numbered from 0 in the order of their smallest id. Rows without hash and fingerprint stand alone.
    """
    rows = materialize(df.select("id", "file_hash", "h"))  # a fingerprint may be dear to make again
    first = rows.where("file_hash IS NOT NULL").groupBy("file_hash").agg(F.min("id").alias("first"))
    heads = rows.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("head"))
    near = hamming_pairs(rows, radius).join(heads.select(F.col("h").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("h").alias("b"), F.col("head").alias("y")), "b")
    links = (
        rows.join(first, "file_hash").select(F.col("id").alias("x"), F.col("first").alias("y"))
        .unionByName(rows.join(heads, "h").select(F.col("id").alias("x"), F.col("head").alias("y")))
        .unionByName(near.select("x", "y"))
    )
    components = connected_components(links, "x", "y").withColumnRenamed("node", "id")
    rooted = rows.join(components, "id", "left").select("id", F.coalesce("component", "id").alias("root"))
    return df.join(dense_ids(rooted, "root", "group_id").select("id", "group_id"), "id")


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with name: the rank from 0 of its key among all keys. Keys are counted by range, none passes one task alone."""
    keys = df.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    placed = keys.select(key, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    placed = materialize(placed)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(placed.join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("place")).alias(name)), key, "left")
