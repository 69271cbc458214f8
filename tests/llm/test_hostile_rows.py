"""Null, empty, very long, repeated and clashing rows through every operator that judges a row by itself."""

import random

import pytest
from pyspark.sql import functions as F

from lodeflow.llm import html_text, license_scan, lm_scoring, media_columns, piece_encoding, quality_classifier, quality_rules
from lodeflow.llm.ngram_jaccard import jaccard_components

CLASH = ["kept", "score", "n_tokens", "p_good", "family", "n_license", "media", "ids", "n_words", "posterior", "n_chars", "row", "pair", "component_id"]


def long_text(words=40_000, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "Stone", "été", "walks,", "over", "the", "bridge.\n"]) for _ in range(words))


LONG = long_text()
ROWS = [
    (0, ""), (1, None), (2, " \n\t"), (3, "one"), (4, LONG), (5, LONG), (5, LONG), (5, "an other text under one id"), (None, "one"), (None, None), (None, LONG),
    (6, "a" * 100_000), (7, " " * 100_000), (8, "\n" * 5000), (9, "same words same words same words same words"), (10, "same words same words same words same words"),
    (11, "\x00 nul   \U0001f600 ﻿"), (12, "Permission is hereby granted, free of charge, to any person obtaining a copy\n" * 400),
]


def rules(df):
    labels = df.sparkSession.createDataFrame([(4, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return quality_rules.quality_rules(df, quality_rules.fit(df, labels))


def lm(df):
    marked = df.withColumn("held_out", lm_scoring.held_out_column())
    model = lm_scoring.fit(marked.where("NOT held_out"))
    by_broadcast, by_joins = (lm_scoring.score(marked, model, size).orderBy("doc_id", "n_tokens", "n_known", "score") for size in (1 << 40, 0))
    for a, b in zip(by_broadcast.collect(), by_joins.collect(), strict=True):
        assert a[:5] == b[:5] and abs(a.score - b.score) < 1e-9 * max(1, abs(a.score))
    return by_broadcast.withColumns({c: F.round(c, 6) for c in ("score", "base_score")})


OPERATORS = {
    "media": lambda df: media_columns.digests(media_columns.store(df)),
    "licences": lambda df: license_scan.license_scan(df, license_scan.fit(df)),
    "language model": lm,
    "pieces": lambda df: piece_encoding.encode(df, piece_encoding.public_pieces()),
    "weak labels": lambda df: quality_classifier.quality_classifier(df, quality_classifier.fit(df)),
    "quality rules": rules,
    "pages": lambda df: html_text.extract(df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *CLASH[:10])).withColumnRenamed("page_id", "doc_id"),
}


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * len(CLASH)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH))


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay_and_equal_texts_agree(spark, name):
    found = OPERATORS[name](table(spark, ROWS)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in ROWS)
    said = {}
    for r in found:
        said.setdefault(r.doc_id, []).append({k: v for k, v in r.asDict(True).items() if k not in ("doc_id", "held_out")})
    key = lambda x: sorted(map(str, x))
    assert said[0] == said[1] and said[4][0] in said[5] and said[4][0] in said[None] and said[3][0] in said[None] and said[1][0] in said[None]
    assert said[9] == said[10] and len(set(key(said[5]))) == 2
    nothing = OPERATORS[name](table(spark, []))
    assert nothing.count() == 0


def test_long_article_is_whole(spark):
    body = " ".join(f"Sentence {i} of the story, told in full." for i in range(20_000))
    page = f"<html><body><nav><a href=x>home</a></nav><article><h1>Title</h1><p>{body}</p></article><footer>end</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, page)], "page_id long, url string, html string")
    assert {(r.text, r.n_chars) for r in html_text.extract(df).collect()} == {("Title\n" + body, len(body) + 6)}


def test_very_long_near_copies_link(spark):
    words = [f"w{i}" for i in range(120_000)]
    other = [*words[:60_000], "changed", *words[60_001:]]
    rows = [(7, " ".join(words)), (3, " ".join(other)), (9, " ".join(words[:90_000])), (1, None), (2, "")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, rows), 4, 85).collect()}
    assert found == {7: (119_997, 3), 3: (119_997, 3), 9: (89_997, 9), 1: (0, 1), 2: (0, 2)}
