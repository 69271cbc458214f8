"""Quality rules: fixed base rules, then a calibrated hashed n-gram classifier against a fixed threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm import text_stats
from lodeflow.llm.hashed_linear import HashedLinear
from lodeflow.llm.labelled import fit_in_task, labelled_sample
from lodeflow.llm.words import Texts, Words, release, slices
from lodeflow.session import bound_batches

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows of each class that the classifier is fitted on at most.
SAMPLE_PER_CLASS = 1000
#: A text stays if the calibrated probability that it is good is at least this.
KEEP_AT = 0.5
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double"


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> HashedLinear:
    """Train on a bounded sample of the rows labelled 0 or 1 in labels.quality; see labelled_sample."""
    return fit_in_task(labelled_sample(docs, labels, "quality", per_class))


def judge(texts: Texts, model: HashedLinear, keep_at: float) -> dict[str, np.ndarray]:
    words = Words.of(texts)
    n = words.counts
    repeats = text_stats.words_in_repeats(words)
    failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
    good = model.probabilities(texts)
    return {
        "n_words": n,
        "word_chars": text_stats.word_chars(texts, words),
        "n_symbols": text_stats.symbols(texts),
        "n_dup_lines": text_stats.repeated_lines(texts, words)[0],
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": ~failed & (good >= keep_at),
        "p_good": good,
    }


def quality_rules(docs: DataFrame, model: HashedLinear, keep_at: float = KEEP_AT) -> DataFrame:
    """One row of counts and verdicts for each row of docs (doc_id, text; other columns are not read).

    A null or empty text has no words, so the base rules reject it. Equal texts get equal rows; repeated and
    null ids stay as they are; an empty table gives an empty one. A very long text is counted and scored whole, its words
    hashed in segments.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "text"):
            found = judge(Texts.of(batch.column("text")), model, keep_at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *map(pa.array, found.values())], names=["doc_id", *found])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_rows(docs: DataFrame, keep: Callable[[Texts], np.ndarray]) -> DataFrame:
    """The rows of docs, all columns as they are, for whose text keep says True."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier tasks of this worker have left
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(keep(Texts.of(batch.column("text")))))
        release()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(pick, docs.schema)


def keep_good(docs: DataFrame, model: HashedLinear, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that quality_rules keeps, with all their columns."""
    return keep_rows(docs, lambda texts: judge(texts, model, keep_at)["kept"])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
