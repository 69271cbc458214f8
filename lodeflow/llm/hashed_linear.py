"""Hashed word and character n-gram logistic regression, shared by the two document classifiers.

A text's features are its word unigrams, word bigrams (one extra feature marks a word that repeats its
neighbour), and character 3- and 4-grams, each hashed into its own table of 2**BITS weights. A kind's
features are averaged over the text, so a score does not depend on length. Every n-gram of a text counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from lodeflow.llm.words import U, Texts, Words, mix, running, window_starts, windows

BITS = 14
KINDS = ("word", "word pair", "3 characters", "4 characters")
_SIZE = 1 << BITS
_SCALE = 12.0


def _gram_features(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the hashed feature of every n-gram, and the bounds of each text's n-grams. One kind is made, and held, after the other."""
    texts = texts.lower()
    words = Words.of(texts)
    mask = U(_SIZE - 1)
    yield (words.hashes & mask).astype(np.int64), words.bounds
    starts, owner = window_starts(words.bounds, 2)
    pairs = windows(words.hashes, 2)
    same = np.zeros(len(pairs), bool)
    if len(pairs):
        same = words.hashes[1:] == words.hashes[:-1]
    pairs = np.where(same, U(1), pairs & mask).astype(np.int64)
    yield pairs[starts], np.searchsorted(owner, np.arange(len(texts) + 1))
    del words, pairs, same, starts, owner
    code, at = _code_points(texts)
    for size in (3, 4):
        grams = np.zeros(max(len(code) - size + 1, 0), np.uint32)
        for j in range(size):
            grams = grams * np.uint32(0x01000193) + code[j : j + len(grams)]
        grams ^= grams >> np.uint32(15)
        grams = (grams * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        starts, owner = window_starts(at, size)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        del owner
        grams = grams[starts]
        del starts
        yield grams.astype(np.int64), bounds


def _code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(texts.data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    leads = running((texts.data & 0xC0) != 0x80)
    return code, leads[texts.offsets]


@dataclass(frozen=True)
class HashedLinear:
    """Weights by kind, a bias, and the calibration of scores to probabilities (Platt's two numbers)."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def of(cls, weights: bytes, bias: float, slope: float, shift: float) -> HashedLinear:
        return cls(np.frombuffer(weights, np.float32).reshape(len(KINDS), -1), bias, slope, shift)

    def scores(self, texts: Texts) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for table, (grams, bounds) in zip(self.weights, _gram_features(texts), strict=True):
            sums = running(table[grams])[bounds]
            total += _SCALE * np.diff(sums) / np.maximum(np.diff(bounds), 1)
        return total

    def probabilities(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.scores(texts) + self.shift)))


def _matrix(texts: list[str], some: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every nonzero mean count, worked out for some texts at a time."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), some):
        for kind, (grams, bounds) in enumerate(_gram_features(Texts.of(pa.array(texts[at : at + some], pa.large_string())))):
            n = np.diff(bounds)
            key, count = np.unique(np.repeat(np.arange(len(n)), n) << BITS | grams, return_counts=True)
            row = key >> BITS
            found.append(((row + at).astype(np.int32), ((key & (_SIZE - 1)) + kind * _SIZE).astype(np.int32), (_SCALE * count / n[row]).astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def train(texts: list[str], target: np.ndarray, weight: np.ndarray, steps: int = 150, decay: float = 1e-4) -> HashedLinear:
    """Fit on four fifths of the rows by Adam over full batches, calibrate on the fifth held out.

    target: probabilities of the positive class; weight: of each row. Rows come in a fixed order, so the
    model is the same each time. With no rows, or rows of one class only, the bias alone says so.
    """
    weights = np.zeros(len(KINDS) * _SIZE)
    if not len(texts):
        return HashedLinear(weights.reshape(len(KINDS), -1), 0.0)
    row, column, value = _matrix(texts)
    held = np.arange(len(texts)) % 5 == 4
    use = np.where(held, 0.0, weight)
    use = use / max(use.sum(), 1e-12)
    bias = 0.0
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, steps + 1):
        score = bias + np.bincount(row, value * weights[column].astype(np.float32), len(texts))
        error = use * (1 / (1 + np.exp(-score)) - target)
        slope = np.append(np.bincount(column, value * error[row].astype(np.float32), len(weights)) + decay * weights, error.sum())
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    score = bias + np.bincount(row, value * weights[column].astype(np.float32), len(texts))
    fitted = HashedLinear(weights.reshape(len(KINDS), -1).astype(np.float32), float(bias))
    if not held.any() or weight[held].sum() == 0:
        return fitted
    a, b = _platt(score[held], target[held], weight[held])
    return HashedLinear(fitted.weights, fitted.bias, a, b)


def _platt(score: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton steps for probability = sigmoid(a * score + b), with Platt's smoothed targets and a small prior at a = 1."""
    yes, no = (weight * target).sum(), (weight * (1 - target)).sum()
    goal = target * (yes + 1) / (yes + 2) + (1 - target) / (no + 2)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a * score + b)))
        e, h = weight * (p - goal), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(e * score).sum() + a - 1, e.sum()])
        m = np.array([[(h * score * score).sum() + 1, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = float(a - np.clip(step[0], -1, 1)), float(b - np.clip(step[1], -2, 2))
        if abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0.05 else (1.0, 0.0)
