"""The Hamming join against a comparison of all pairs, with keys that are shared by very many."""

import random

import numpy as np
import pytest

from lodeflow.operators import dedup


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [0, 2, 5, 8])
@pytest.mark.parametrize("full", [0, 40, 10**6])
def test_all_pairs(spark, radius, full):
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(12)]
    made = [b ^ sum(1 << i for i in draw.sample(range(64), draw.randrange(7))) for b in base for _ in range(5)]
    made += [(draw.getrandbits(43) << 21) | 12345 for _ in range(60)]  # one low segment for all
    made = sorted({signed(x) for x in made})
    found = sorted(map(tuple, dedup.hamming_pairs(spark.createDataFrame([(h,) for h in made + made[:3] + [None]], "h long"), radius, full).collect()))
    want = [(a, b, bin((a ^ b) & (1 << 64) - 1).count("1")) for i, a in enumerate(made) for b in made[i + 1 :]]
    assert found == sorted(p for p in want if p[2] <= radius)


def test_a_key_of_very_many(spark):
    """20,000 fingerprints that are alike in one segment: split by a second one, their 200 planted pairs are found."""
    draw = random.Random(6)
    rows = list({(draw.getrandbits(43) << 21) | 77 for _ in range(20_000)})
    planted = [(x, x ^ (0b1011 << 30) ^ (0b11 << 55)) for x in rows[:200]]
    made = [(signed(x),) for x in rows] + [(signed(y),) for _, y in planted]
    found = {(r.a, r.b) for r in dedup.hamming_pairs(spark.createDataFrame(made, "h long"), 5, 5000).collect()}
    assert {tuple(sorted(map(signed, p))) for p in planted} <= found


def test_bit_counts():
    draw = np.random.default_rng(1)
    digests, bounds = draw.integers(0, 256, (1500, 8)).astype(np.uint8), np.array([0, 1, 255, 510, 766, 1500])
    want = [np.unpackbits(digests[a:b], axis=1).sum(axis=0) for a, b in zip(bounds, bounds[1:])]
    assert (dedup._bit_counts(digests, bounds) == np.array(want)).all()


def test_keys_are_not_broadcast(spark):
    """Some fingerprints are a small file, their keys are 67 times as many: neither side of the join is sent to every task."""
    rows = spark.createDataFrame([(h,) for h in range(0, 1 << 40, 1 << 31)], "h long")
    plan = dedup.hamming_pairs(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
