"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The counts of the vote patterns
(at most 3 ** number of labellers, whatever the input) are all that expectation-maximisation needs to estimate
each labeller's accuracy and the share of good documents. The posteriors then label a bounded sample on which
a hashed linear scorer is trained, and the scorer judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm import text_stats
from lodeflow.llm.hashed_linear import HashedLinear
from lodeflow.llm.labelled import fit_in_task, short_enough
from lodeflow.llm.quality_rules import keep_rows
from lodeflow.llm.words import Texts, Words, release, running, slices
from lodeflow.session import materialize

#: Documents on either side of an even posterior that the scorer is trained on at most.
SAMPLE_PER_SIDE = 1000
KEEP_AT = 0.5
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _vote(value: np.ndarray, good_to: float, bad_from: float) -> np.ndarray:
    return np.where(value <= good_to, 1, np.where(value >= bad_from, -1, 0))


def votes(texts: Texts) -> np.ndarray:
    """A row for each labeller: 1 good, -1 bad, 0 no opinion."""
    words = Words.of(texts.lower())
    n = np.maximum(words.counts, 1)
    size = np.maximum(np.diff(texts.offsets), 1)
    letters = texts.per_text(_LETTER[texts.data])
    marks = texts.per_text(texts.data == 33) + texts.per_text(texts.data == 124)
    dup, lines = text_stats.repeated_lines(texts, words)
    distinct = text_stats.distinct_words(words)
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[words.bounds[:-1][words.counts > 0]] = False  # a text's first word repeats none
    long = np.log(np.maximum(words.counts, 2))
    found = [
        _vote(text_stats.symbols(texts) / size, 0.01, 0.05),
        _vote(texts.per_text(_UPPER[texts.data]) / np.maximum(letters, 1), 0.10, 0.35),
        _vote(-distinct / n, -0.45, -0.20),
        _vote(text_stats.words_in_repeats(words) / n, 0.10, 0.30),
        _vote(marks / n, 0.05, 0.30),
        _vote(np.diff(running(same)[words.bounds]) / n, 0.02, 0.20),
        _vote(-letters / size, -0.70, -0.55),
        np.where(lines < 3, 0, _vote(dup / np.maximum(lines, 1), 0.2, 0.6)),
        _vote(-distinct / np.maximum(n / long, 1), -1.2, -0.5),
    ]
    return np.where(words.counts == 0, -1, np.array(found))


N_LABELLERS = 9


def pattern_of(texts: Texts) -> np.ndarray:
    return ((votes(texts) + 1) * (3 ** np.arange(N_LABELLERS))[:, None]).sum(axis=0)


@dataclass(frozen=True)
class LabelModel:
    """prior: share of good documents; chances[labeller, class, vote + 1]."""

    prior: float
    chances: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        cast = (np.asarray(patterns)[None, :] // (3 ** np.arange(N_LABELLERS))[:, None]) % 3
        which = np.arange(N_LABELLERS)[:, None]
        bad = np.log(1 - self.prior) + np.log(self.chances[which, 0, cast]).sum(axis=0)
        good = np.log(self.prior) + np.log(self.chances[which, 1, cast]).sum(axis=0)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller where it votes."""
        right = self.prior * self.chances[:, 1, 2] + (1 - self.prior) * self.chances[:, 0, 0]
        wrong = self.prior * self.chances[:, 1, 0] + (1 - self.prior) * self.chances[:, 0, 2]
        return right / np.maximum(right + wrong, 1e-12)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Fit from each pattern's count. The start takes any bad vote for a bad document."""
    cast = (patterns[None, :] // (3 ** np.arange(N_LABELLERS))[:, None]) % 3
    balance = (cast == 2).sum(axis=0) - 10.0 * (cast == 0).sum(axis=0)
    good = 1 / (1 + np.exp(-balance))
    model = LabelModel(0.5, np.full((N_LABELLERS, 2, 3), 1 / 3))
    for _ in range(rounds if len(patterns) else 0):
        chances = np.empty((N_LABELLERS, 2, 3))
        for side, share in enumerate((1 - good, good)):
            mass = counts * share
            for vote in range(3):
                chances[:, side, vote] = ((cast == vote) * mass).sum(axis=1) + 1.0
        model = LabelModel(float(np.clip((counts * good).sum() / counts.sum(), 0.01, 0.99)), chances / chances.sum(axis=2, keepdims=True))
        good = model.posterior(patterns)
    return model


def _patterns(docs: DataFrame) -> DataFrame:
    """The vote pattern of every text, by the text's hash."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array(pattern_of(Texts.of(batch.column("text"))).astype(np.int64))], names=["rank", "pattern"])

    return docs.select(_rank(), "text").mapInArrow(cast, "rank bigint, pattern bigint")


def _rank() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("rank")


@dataclass(frozen=True)
class WeakClassifier:
    labels: LabelModel
    scorer: HashedLinear


def fit(docs: DataFrame, per_side: int = SAMPLE_PER_SIDE) -> WeakClassifier:
    """Vote statistics over all documents; the scorer on at most 2 * per_side of them, chosen by their texts' hash."""
    cast = materialize(_patterns(docs))
    table = cast.groupBy("pattern").count().collect()  # at most 3 ** N_LABELLERS rows
    table.sort(key=lambda r: r.pattern)
    patterns = np.array([r.pattern for r in table], np.int64)
    labels = expectation_maximisation(patterns, np.array([r["count"] for r in table], float))
    good = patterns[labels.posterior(patterns) >= 0.5].tolist() if len(patterns) else []
    is_good = F.col("pattern").isin(good) if good else F.lit(False)
    distinct = cast.groupBy("rank").agg(F.min("pattern").alias("pattern"))
    chosen = distinct.where(is_good).orderBy("rank").limit(per_side).unionByName(distinct.where(~is_good).orderBy("rank").limit(per_side))
    texts = docs.where(short_enough("text")).select(_rank(), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "rank")
    rows = texts.groupBy("rank").agg(F.min("pattern").alias("pattern"), F.min("text").alias("text"))  # at most 2 * per_side
    chances = dict(zip(patterns.tolist(), labels.posterior(patterns).tolist(), strict=True)) if len(patterns) else {}
    target = F.create_map(*(F.lit(x) for pair in chances.items() for x in pair))[F.col("pattern")] if chances else F.lit(0.5)
    return WeakClassifier(labels, fit_in_task(rows.select("rank", "text", target.alias("target"))))


SCHEMA = "doc_id bigint, votes_good int, votes_bad int, posterior double, p_good double, kept boolean"


def quality_classifier(docs: DataFrame, model: WeakClassifier, keep_at: float = KEEP_AT) -> DataFrame:
    """Votes, posterior, the scorer's probability and its verdict for each row of docs (doc_id, text).

    A null or empty text gets bad votes only. Ties, repeated rows and null ids each get a row; an empty table
    gives an empty one; other columns are not read. A very long text is voted on and scored whole.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            texts = Texts.of(batch.column("text"))
            cast = votes(texts)
            pattern = ((cast + 1) * (3 ** np.arange(N_LABELLERS))[:, None]).sum(axis=0)
            p = model.scorer.probabilities(texts)
            columns = [(cast == 1).sum(axis=0).astype(np.int32), (cast == -1).sum(axis=0).astype(np.int32), model.labels.posterior(pattern), p, p >= keep_at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, columns)], names=["doc_id", "votes_good", "votes_bad", "posterior", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, model: WeakClassifier, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that the scorer keeps, with all their columns."""
    return keep_rows(docs, lambda texts: model.scorer.probabilities(texts) >= keep_at)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_classifier(docs, fit(docs))
