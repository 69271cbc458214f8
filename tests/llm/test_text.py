"""Words, statistics and classifiers against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodeflow.llm import quality_classifier, quality_rules, text_stats
from lodeflow.llm.hashed_linear import train
from lodeflow.llm.words import Texts, Words, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CASES = ["", None, " ", "one", "a a a a a a a a a a a a", "é ü\x0bß\n\n x  x\t", "line one\nline one\n \n \nline two\n", "#*$ %&| <>\n" * 3, "\x85no\xa0space " * 4, "x" * 5000]


def many(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "été", "a", "b", "#x", "longer", "\U0001f600"]
    return CASES + ["".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(80))) for _ in range(n)]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_match_plain_python():
    texts = many()
    flat = Texts.of(pa.array(texts))
    words = Words.of(flat)
    found = zip(words.counts, text_stats.word_chars(flat, words), text_stats.symbols(flat), text_stats.repeated_lines(flat, words)[0], text_stats.words_in_repeats(words), strict=True)
    assert [tuple(map(int, x)) for x in found] == [brute(t) for t in texts]
    assert text_stats.distinct_words(words).tolist() == [len(set(WORD.findall(t or ""))) for t in texts]


def test_slices_keep_all_rows():
    texts = many()
    batch = pa.record_batch({"text": pa.array(texts)})
    parts = list(slices(iter([batch, batch.slice(0, 0)]), "text", 50))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 5


def test_hashes_depend_on_bytes_alone():
    flat = Texts.of(pa.array(["ab cd ab", "cd", "abc d", "ab"]))
    words = Words.of(flat)
    seen = dict(zip([flat.data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)], words.hashes.tolist(), strict=True))
    assert len(set(seen.values())) == 4 and words.hashes[0] == words.hashes[2] == words.hashes[-1]


DOCS = "doc_id long, text string, source string, label string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    words = ["river", "stone", "cloud", "walks", "over", "the", "old", "bridge", "slowly", "today", "and", "sings"]
    rows, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30, 90)))
        if i % 3 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 2 else " ".join(w + "$$$" for w in text.split())
        rows.append((i, text))
        labels.append((i, int(i % 3 != 0), 0))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int"), dict(labels and [(a, b) for a, b, _ in labels])


def test_quality_rules_hold_out(spark, labelled):
    table, labels, truth = labelled
    model = quality_rules.fit(table, labels, 60)
    found = {r.doc_id: r.kept for r in quality_rules.quality_rules(table, model).collect()}
    assert np.mean([found[i] == bool(q) for i, q in truth.items()]) > 0.97
    kept = quality_rules.keep_good(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, k in found.items() if k}


def test_quality_rules_edges(spark, labelled):
    table, labels, _ = labelled
    model = quality_rules.fit(table, labels, 60)
    rows = [*enumerate(CASES), (0, ""), (None, "ab " * 20)]
    found = quality_rules.quality_rules(docs(spark, rows), model).collect()
    assert len(found) == len(rows)
    for (_, text), r in zip(rows, found, strict=True):
        n, *rest = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[3] > 20 * n) and not (r.base_failed and r.kept)
    empty = docs(spark, [])
    assert quality_rules.quality_rules(empty, quality_rules.fit(empty, labels.limit(0))).count() == 0


def test_weak_labels(spark, labelled):
    table, _, truth = labelled
    model = quality_classifier.fit(table, 80)
    found = {r.doc_id: r.kept for r in quality_classifier.quality_classifier(table, model).collect()}
    assert np.mean([found[i] == bool(q) for i, q in truth.items()]) > 0.95
    kept = quality_classifier.keep_good(table, model)
    assert {r.doc_id for r in kept.collect()} == {i for i, k in found.items() if k}
    assert quality_classifier.quality_classifier(docs(spark, [*enumerate(CASES), (None, None)]), model).count() == len(CASES) + 1
    empty = docs(spark, [])
    assert quality_classifier.quality_classifier(empty, quality_classifier.fit(empty)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    k, n = quality_classifier.N_LABELLERS, 20000
    good = rng.random(n) < 0.8
    right = np.linspace(0.97, 0.85, k)
    votes = np.where(rng.random((k, n)) < right[:, None], good, ~good) * 2 - 1
    votes = np.where(rng.random((k, n)) < 0.3, 0, votes)
    patterns, counts = np.unique(((votes + 1) * (3 ** np.arange(k))[:, None]).sum(axis=0), return_counts=True)
    model = quality_classifier.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.02 and np.abs(model.accuracies() - right).max() < 0.02


def test_training_without_rows():
    model = train([], np.zeros(0), np.zeros(0))
    assert model.probabilities(Texts.of(pa.array(["x", None]))).tolist() == [0.5, 0.5]


def test_scores_hold_one_kind_of_grams_at_a_time():
    """A slice of 2 MB is scored in less than 50 bytes of arrays a byte of text, and tasks of other kinds forget what a worker keeps for packing."""
    import tracemalloc

    from lodeflow.llm import packing, words
    from lodeflow.llm.hashed_linear import _SIZE, KINDS, HashedLinear

    rng = np.random.default_rng(1)
    texts = words.Texts.of(pa.array([" ".join(f"w{i}" for i in rng.integers(0, 5000, 400)) for _ in range(900)]))
    model = HashedLinear(rng.normal(size=(len(KINDS), _SIZE)).astype(np.float32), 0.1)
    model.scores(texts)  # the tables of powers stay
    tracemalloc.start()
    model.scores(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * len(texts.data)
    path = packing.public_tokenizer()
    packing.word_tokenizer(path)
    words.release("tokenizer")
    assert packing._tokenizers
    words.release()
    assert not packing._tokenizers and packing.word_tokenizer(path).encode([b"a b"])
