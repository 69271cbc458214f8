"""Probabilities, verdicts and base columns of the trained operators, and the whole pipeline, against plain versions."""

import math
import re
import zlib
from functools import lru_cache
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lodeflow.llm import hashed_linear, packing, quality_classifier, quality_rules
from lodeflow.llm.queries import QUERIES
from lodeflow.llm.words import Texts, Words, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SQL_WORD = r"[^\x20\x09-\x0D]+"
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@lru_cache(None)
def word_hash(word):
    return Words.of(Texts.of(pa.array([word]))).hashes[0]


@lru_cache(None)
def pair_hash(a, b):
    return int(windows(np.array([word_hash(a), word_hash(b)], np.uint64), 2)[0])


@lru_cache(None)
def gram_hash(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c)) % (1 << 32)
    h ^= h >> 15
    return (h * 0x2C1B3C6D) % (1 << 32) >> (32 - hashed_linear.BITS)


def plain_features(text):
    text, mask = lower(text), (1 << hashed_linear.BITS) - 1
    words = WORD.findall(text)
    yield [int(word_hash(w)) & mask for w in words]
    yield [1 if a == b else pair_hash(a, b) & mask for a, b in pairwise(words)]
    for size in (3, 4):
        yield [gram_hash(text[i : i + size]) for i in range(len(text) - size + 1)]


def plain_probability(text, model):
    score = model.bias
    for weights, features in zip(model.weights, plain_features(text), strict=True):
        score += 12.0 * sum(float(weights[f]) for f in features) / max(len(features), 1)
    return 1 / (1 + math.exp(-(model.slope * score + model.shift)))


ODD = ["", None, " \n", "one", "Ab ab AB aB", "é ü\x0bß x", "\U0001f600" * 30, "x" * 3000, "word " * 2000]


def test_probabilities_and_verdicts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules, weak = quality_rules.fit(docs, labels), quality_classifier.fit(docs)
    texts = [r.text for r in docs.select("text").collect()] + ODD * 2
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, p_good string")
    for name, found, model in (("rules", quality_rules.quality_rules(rows, rules), rules), ("weak", quality_classifier.quality_classifier(rows, weak), weak.scorer)):
        found = {r.doc_id: r for r in found.collect()}
        assert len(found) == len(texts)
        for i, text in enumerate(texts):
            want = plain_probability(text, model)
            assert abs(found[i].p_good - want) < 1e-6, (name, i)
            if abs(want - 0.5) > 1e-6:
                assert found[i].kept == (want >= 0.5 and not (name == "rules" and found[i].base_failed))


def test_training_and_calibration():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["river", "stone", "Cloud", "buy!!", "now$", "é"], 25, p=[0.3, 0.3, 0.2, 0.1, 0.05, 0.05] if i % 2 else [0.1, 0.2, 0.2, 0.3, 0.1, 0.1])) for i in range(60)]
    target, weight = np.clip(np.arange(60) % 2 + 0.0, 0.1, 0.9), rng.uniform(0.5, 1.5, 60)
    model = hashed_linear.train(texts, target, weight, steps=40)
    dense = np.zeros((60, 4 << hashed_linear.BITS))
    for i, text in enumerate(texts):
        for kind, features in enumerate(plain_features(text)):
            for f in features:
                dense[i, (kind << hashed_linear.BITS) + f] += 12.0 / len(features)
    held = np.arange(60) % 5 == 4
    use = np.where(held, 0, weight) / weight[~held].sum()
    w, first, second = (np.zeros(dense.shape[1] + 1) for _ in range(3))
    for step in range(1, 41):
        error = use * (1 / (1 + np.exp(-(dense @ w[:-1] + w[-1]))) - target)
        slope = np.append(dense.T @ error + 1e-4 * w[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    score = dense @ w[:-1] + w[-1]
    assert np.abs(model.scores(Texts.of(pa.array(texts))) - score).max() < 0.02
    # the calibration is the least point of its loss: both slopes vanish
    own, y, v = model.scores(Texts.of(pa.array(texts)))[held], target[held], weight[held]
    yes, no = (v * y).sum(), (v * (1 - y)).sum()
    error = v * (1 / (1 + np.exp(-(model.slope * own + model.shift))) - (y * (yes + 1) / (yes + 2) + (1 - y) / (no + 2)))
    assert abs((error * own).sum() + model.slope - 1) < 1e-2 and abs(error.sum()) < 1e-2


def table(spark, sf, con, name="documents"):
    frame = spark.read.parquet(f"{sf}/{name}.parquet").toPandas()
    frame["held"] = [zlib.crc32(str(i).encode()) % 5 == 1 for i in frame.doc_id]
    con.register(name, frame)


def test_lm_base_columns_as_sql(spark, sf):
    con = duckdb.connect()
    table(spark, sf, con)
    want = con.execute(f"""
        WITH tok AS (SELECT doc_id, held, unnest(list_append(regexp_extract_all({SQL_LOWER}, '{SQL_WORD}'), chr(10))) AS w FROM documents),
        counts AS (SELECT w, count(*) AS c FROM tok WHERE NOT held GROUP BY w),
        total AS (SELECT sum(c) AS n, count(*) AS v FROM counts)
        SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens,
            sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score
        FROM tok LEFT JOIN counts USING (w), total GROUP BY doc_id ORDER BY doc_id""").fetchall()
    found = QUERIES["op5_lm_scoring"](spark, sf).orderBy("doc_id").collect()
    assert len(found) == len(want) > 0
    for r, x in zip(found, want, strict=True):
        assert tuple(r)[:5] == x[:5] and abs(r.base_score - x[5]) < 1e-9 * abs(x[5])


def test_quality_base_columns_as_sql(spark, sf):
    con = duckdb.connect()
    table(spark, sf, con)
    want = con.execute(f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') AS words FROM documents),
        lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SQL_WORD}')) AS kept FROM t),
        five AS (SELECT doc_id, i, words[i:i + 4] AS w FROM t, LATERAL (SELECT unnest(generate_series(1, len(words) - 4)) AS i)),
        again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM five),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS j) WHERE n > 1 GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
            len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(kept) - len(list_distinct(kept)) AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words, len(words) < 10 OR 100 * coalesce(n, 0) > 20 * len(words) AS base_failed
        FROM t JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) ORDER BY doc_id""").fetchall()
    found = QUERIES["op10_quality_rules"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r)[:7] for r in found] == want and want


def near_copies(texts, size, percent):
    """The ids that stay: the smallest of each component, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = WORD.findall(lower(text))
        sets[i] = frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) or frozenset([tuple(words)] if words else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in ids if find(i) == i}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_whole_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rules = quality_rules.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    failed = {r.doc_id for r in quality_rules.quality_rules(docs, rules).where("base_failed").collect()}
    kept = {i: t for i, t in texts.items() if i not in failed and plain_probability(t, rules) >= 0.5}
    weak = quality_classifier.fit(corpus_pipeline.materialize(docs.where(docs.doc_id.isin(list(kept)))))
    kept = {i: t for i, t in kept.items() if plain_probability(t, weak.scorer) >= 0.5}
    alone = near_copies(kept, 5, 80)
    assert 0 < len(alone) < len(kept) < len(texts)
    found = corpus_pipeline.run(spark, folder).toPandas()
    assert set(found.doc_id) == alone
    plain = Tokenizer.from_file(packing.public_tokenizer())
    for i, part in found.sort_values("start").groupby("doc_id"):
        ids = np.array([*plain.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (part.doc_tokens == len(ids)).all() and part.start.tolist() == np.cumsum([0, *part.length])[:-1].tolist() and part.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(part.start, part.length, strict=True)] == part.ids_crc32.tolist()
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == np.cumsum([0, *part.length])[:-1].tolist() and part.length.sum() <= 4096
