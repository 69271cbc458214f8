"""Licence scans with DataFrame and ML functions only.

Paragraphs (lines) become hashed word unigrams and bigrams, of which the features are those that any notice has, too. A
logistic regression with an elastic net penalty, trained on licence notices and on the documents' own lines, every
distinct one, as the class unknown, leaves few features with weights; those alone are looked up when a paragraph is
scored. The probability that a family must reach is calibrated on the lines held out from training, a quarter of all,
and a comparison with the family's notices confirms the prediction.

Paragraphs are lines, windows over all words of the text as long as a long notice (for notices that are wrapped
over several lines), and the words of short notices and titles where they stand word by word. The model judges all
of them alike, and each has the probability that the model gives it; a paragraph is told only with the family that
its comparison confirms.

A paragraph is confirmed by CONFIRM_AT of a notice's distinct words. Of any more than the rest of them it has one at
least, so a text without each of the longest such words of every notice and title holds nothing that could be
confirmed, and its paragraphs need not be judged: `needed` lists these words, made by that rule from the notices.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.session import materialize

UNKNOWN = "unknown"
# Short notices by which works name their licence.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "This software is released under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC BY-SA 4.0 unless otherwise noted.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Licensed under the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "Released under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Licensed under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Titles that stand alone on a line.
TITLES = {
    "agpl": ["GNU Affero General Public License"],
    "apache": ["Apache License", "Apache License 2.0", "Apache License Version 2.0"],
    "boost": ["Boost Software License", "Boost Software License - Version 1.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License"],
    "epl": ["Eclipse Public License", "Eclipse Public License v 2.0"],
    "gpl": ["GNU General Public License"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License"],
    "mit": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "mpl": ["Mozilla Public License", "Mozilla Public License Version 2.0"],
    "unlicense": ["The Unlicense"],
    "zlib": ["zlib License"],
}
#: How a word starts that every long notice has.
STEMS = ("licen", "unlicense", "copyright", "permission", "redistribut", "spdx", "unencumbered", "anyone")
#: Distinct words that a notice has at least to be known by a share of them when it is wrapped.
LONG_NOTICE = 12
BUCKETS = 8192
#: Weight of a line of the documents in training, where a notice has 1, and of all lines together at most.
LINE_WEIGHT, LINES_WEIGHT = 0.05, 150.0
#: Lines that one task of the training holds, about.
TASK_LINES = 65_536
#: Word pairs of one notice from which a line is taken for a fragment of it.
FRAGMENT_PAIRS = 3
#: Share of held-out unknown lines that may reach the threshold, its least and its greatest value, and its step.
FALSE_SHARE, LEAST_PROBABILITY, MOST_PROBABILITY, STEP = 0.001, 0.5, 0.95, 0.0001
#: Held-out lines from which that share says anything; with fewer the least value stands.
CALIBRATION_LINES = 100
#: Share of a notice's words that a confirmed paragraph has.
CONFIRM_AT = 0.6
#: How a text says that something is not under a licence.
NEGATED = r"(?i)\b(?:not|never|no longer|neither)\s+(?:\w+\s+)?(?:licensed|released|distributed|available|covered|provided)\s+(?:under|by)\b"
#: Share of a long and of a short notice's neighbouring word pairs that it has besides.
PAIRS_OF_LONG, PAIRS_OF_SHORT = 0.4, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\s|$)"), lambda w: w != "")


def own_words(text: str) -> list[str]:
    """As words() splits."""
    return [w for w in re.split(r"[^\w.]+|\.(?=\s|$)", text.lower()) if w]


def needed() -> list[str]:
    """Words of which every text has one that holds a paragraph with CONFIRM_AT of a notice's distinct words, or a whole title.

    Of each notice the longest words, just more than a confirmed paragraph may lack; of each title the longest.
    """
    found = set()
    for told, share in [(n, 1 - CONFIRM_AT) for notices in NOTICES.values() for n in notices] + [(t, 0.0) for titles in TITLES.values() for t in titles]:
        own = sorted(set(own_words(told)), key=lambda w: (-len(w), w))
        found |= set(own[: int(share * len(own) + 1e-9) + 1])
    return sorted(found)


def _least_pairs() -> int:
    """The fewest neighbouring word pairs of a notice with which a line can be confirmed."""
    least = []
    for notice in (n for every in NOTICES.values() for n in every):
        own = own_words(notice)
        need = PAIRS_OF_LONG if len(set(own)) >= LONG_NOTICE else PAIRS_OF_SHORT
        least.append(math.ceil(need * len(set(pairwise(own))) - 1e-9))
    return min(least)


def _any_of(ends: list[str]) -> str:
    """A pattern of one of these words, in which words that begin alike share their beginning, so that it is read once."""
    by: dict[str, list[str]] = {}
    for end in ends:
        by.setdefault(end[:1], []).append(end[1:])
    inner = "|".join(re.escape(c) + _any_of(more) for c, more in sorted(by.items()) if c)
    return f"(?:{inner})" + "?" * ("" in by) if inner else ""


def may_hold(text: Column) -> Column:
    """Whether a text has one of the needed words.

    All that is no letter a-z and no digit becomes a space first. Where no word between spaces is needed, nor the first
    such part of a needed word, the text has none; the pattern, which takes longer, reads the other texts only.
    """
    own, plain = F.lower(text), F.lit(None).cast("string")
    parts = F.split(F.mask(own, plain, plain, plain, F.lit(" ")), " ")
    some = F.arrays_overlap(parts, F.array(*(F.lit(w) for w in sorted({re.split("[^a-z0-9]", w)[0] for w in needed()}))))
    return some & own.rlike(rf"(?<![\p{{L}}\p{{N}}]){_any_of(needed())}(?![\p{{L}}\p{{N}}])")


def _neighbours(found: Column, told: Callable[[Column], Column]) -> Column:
    """What told makes of each two neighbouring words, joined as one."""
    first = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    return F.zip_with(first, F.slice(found, F.lit(2), F.size(found)), lambda a, b: told(F.concat(a, F.lit(" "), b)))


def _pairs(found: Column) -> Column:
    """Neighbouring words as one."""
    return _neighbours(found, lambda pair: pair)


def _hashes(found: Column) -> Column:
    """Hashes of word unigrams and bigrams."""
    return F.concat(F.transform(found, lambda w: F.xxhash64(w)), _neighbours(found, F.xxhash64))


def _bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def features(found: Column) -> Column:
    """Buckets of word unigrams and bigrams."""
    return _once(found, lambda found: F.transform(_hashes(found), _bucket))


def _once(value: Column, told: Callable[[Column], Column]) -> Column:
    """told(value), for which value is worked out once a row, however often told names it."""
    return F.get(F.transform(F.array(value), told), F.lit(0))


@dataclass(frozen=True)
class LicenseModel:
    """families, and for each its bias and weights by bucket; threshold: the probability a family must reach."""

    families: list[str]
    biases: list[float]
    weights: list[list[float]]
    threshold: float


def _lines(docs: DataFrame, vocabulary: list[int]) -> DataFrame:
    """held and buckets (those in vocabulary) of every distinct line of docs that is no part of a wrapped notice, which is no example of the class unknown.

    Such a line has FRAGMENT_PAIRS word pairs of one notice; with fewer none can be confirmed (see _least_pairs). Pairs
    are compared as words only in lines that have the hashes of so many; vocabulary has the buckets of all notices.
    """
    orders = [sorted({f"{a} {b}" for a, b in pairwise(own_words(n))}) for every in NOTICES.values() for n in every]
    told, least = _constant(orders, "array<array<string>>"), min(FRAGMENT_PAIRS, _least_pairs())
    inside = _constant([i in set(vocabulary) for i in range(BUCKETS)], "array<boolean>")
    own = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph"))
    own = own.select(F.xxhash64("paragraph").alias("rank"), words(F.col("paragraph")).alias("found"))
    own = own.select("rank", "found", F.filter(_hashes(F.col("found")), lambda h: F.get(inside, _bucket(h))).alias("kept"))
    pairs = sorted({p for order in orders for p in order})
    hashed = docs.sparkSession.createDataFrame([(p,) for p in pairs], "pair string").select(F.xxhash64("pair").alias("h")).collect()
    hits = F.filter(_pairs(F.col("found")), lambda p: p.isin(pairs))
    shared = _once(hits, lambda hits: F.array_max(F.transform(told, lambda order: F.size(F.array_intersect(hits, order)))))
    other = F.when(F.size(F.filter("kept", lambda h: h.isin([r.h for r in hashed]))) < least, True).otherwise(shared < least)
    own = own.select("rank", F.when(other, F.array_distinct(F.transform("kept", _bucket))).alias("buckets")).distinct()
    return materialize(own.select((F.pmod("rank", F.lit(4)) == 0).alias("held"), "buckets")).where("buckets IS NOT NULL")


def fit(docs: DataFrame) -> LicenseModel:
    """Train on the notices and on every distinct line of docs that resembles no notice; a quarter of these, by hash, is held out and calibrates.

    However many lines there are, together they weigh LINES_WEIGHT at most. An empty table leaves the notices against
    one empty line of the class unknown.
    """
    spark = docs.sparkSession
    families = [*NOTICES, UNKNOWN]
    rows = [(families.index(f), told) for part in (NOTICES, TITLES) for f, every in part.items() for told in every]
    for f, every in NOTICES.items():  # long notices as windows find them, too: without their first or last quarter
        cuts = [(n.split(), len(n.split()) // 4) for n in every if len(set(own_words(n))) >= LONG_NOTICE]
        rows += [(families.index(f), " ".join(own)) for n, k in cuts for own in (n[k:], n[:-k])]
    known = spark.createDataFrame([*rows, (len(families) - 1, "")], "label int, paragraph string")
    known = known.select("label", F.array_distinct(features(words(F.col("paragraph")))).alias("buckets"))
    vocabulary = sorted({i for r in known.collect() for i in r.buckets})
    lines = _lines(docs, vocabulary)
    n = {r.held: r["count"] for r in lines.groupBy("held").count().collect()}
    weight = min(LINE_WEIGHT, LINES_WEIGHT / max(n.get(False, 0), 1))
    train = known.unionByName(lines.where("NOT held").select(F.lit(len(families) - 1).alias("label"), "buckets"))
    prepared = train.select(F.col("label").cast("double").alias("label"), F.transform("buckets", lambda i: i.cast("string")).alias("buckets"), F.when(F.col("label") == len(families) - 1, weight).otherwise(1.0).alias("weight"))
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in vocabulary], "buckets", "features", minTF=1.0, binary=True)
    trainer = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.3, maxIter=60, weightCol="weight", standardization=False)
    fitted = trainer.fit(counts.transform(prepared.coalesce(1 + n.get(False, 0) // TASK_LINES)))  # a task of many lines at each of the steps
    matrix = fitted.coefficientMatrix.toArray()
    weights = [[0.0] * BUCKETS for _ in matrix]
    for own, row in zip(weights, matrix, strict=True):
        for i, x in zip(vocabulary, row, strict=True):
            own[i] = round(float(x), 6)
    model = LicenseModel(families[: len(weights)], [float(x) for x in fitted.interceptVector], weights, LEAST_PROBABILITY)
    return LicenseModel(model.families, model.biases, model.weights, _threshold(lines.where("held"), model) if n.get(True, 0) >= CALIBRATION_LINES else LEAST_PROBABILITY)


def _threshold(held: DataFrame, model: LicenseModel) -> float:
    """The least multiple of STEP between the bounds that FALSE_SHARE of the lines held out reach at most."""
    steps = F.floor(F.greatest(_told(_active("buckets", model), model)["probability"], F.lit(LEAST_PROBABILITY - STEP / 2)) / STEP).cast("int")
    table = held.groupBy(F.when(F.size(_active("buckets", model)) > 0, steps).otherwise(-1).alias("step")).count().collect()  # one row a step at most
    room, reached = FALSE_SHARE * sum(r["count"] for r in table), 0
    for r in sorted(table, key=lambda r: -r.step):
        reached += r["count"]
        if reached > room:
            return min(max(LEAST_PROBABILITY, (r.step + 1) * STEP), MOST_PROBABILITY)
    return LEAST_PROBABILITY


def _constant(value: list, kind: str) -> Column:
    """A table written down as one literal, so that plans stay small."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _similarity(found: Column, family: Column) -> Column:
    """The largest share of a notice's distinct words among found, of the family's notices.

    A notice counts only if enough of its word pairs stand there, too, so that the words come in its order.
    """
    table = []
    for name, notices in NOTICES.items():
        for own in map(own_words, notices):
            told, order = list(dict.fromkeys(own)), list(dict.fromkeys(f"{a} {b}" for a, b in pairwise(own)))
            need = PAIRS_OF_LONG if len(told) >= LONG_NOTICE else PAIRS_OF_SHORT
            table.append({"family": name, "words": told, "pairs": order, "need": need * len(order)})
    every = _constant(table, "array<struct<family:string,words:array<string>,pairs:array<string>,need:double>>")

    def compare(own: Column, pairs: Column) -> Column:
        share = lambda n: F.when(F.size(F.array_intersect(pairs, n["pairs"])) >= n["need"], F.size(F.array_intersect(own, n["words"])) / F.size(n["words"])).otherwise(0.0)
        return F.array_max(F.transform(F.filter(every, lambda n: n["family"] == family), share))

    inner = lambda own: F.get(F.transform(F.array(_pairs(own)), lambda pairs: compare(own, pairs)), F.lit(0))
    return F.get(F.transform(F.array(found), inner), F.lit(0))


def _active(buckets: Column | str, model: LicenseModel) -> Column:
    """The buckets that have any weight, as places in the table of weights."""
    used = [i for i in range(BUCKETS) if any(w[i] for w in model.weights)]
    place = dict(zip(used, range(len(used)), strict=True))
    places = _constant([place.get(i, -1) for i in range(BUCKETS)], "array<int>")
    return F.filter(F.transform(buckets, lambda i: F.get(places, i)), lambda i: i >= 0)


def _told(active: Column, model: LicenseModel) -> Column:
    """family: the likeliest one, unknown left out; probability: its own among all."""
    used = [i for i in range(BUCKETS) if any(w[i] for w in model.weights)]
    table = _constant([{"bias": b, "weights": [w[i] for i in used]} for b, w in zip(model.biases, model.weights, strict=True)], "array<struct<bias:double,weights:array<double>>>")
    named = len(model.families) - 1
    names = _constant(model.families, "array<string>")

    def judge(logits: Column) -> Column:
        best = F.array_max(F.slice(logits, 1, named))
        total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - best))
        return F.struct(F.element_at(names, F.array_position(logits, best).cast("int")).alias("family"), (1 / total).alias("probability"))

    logits = lambda active: F.transform(table, lambda t: F.aggregate(active, t["bias"], lambda s, i: s + F.get(t["weights"], i)))
    bound = F.transform(F.array(active), lambda active: F.get(F.transform(F.array(logits(active)), judge), F.lit(0)))
    return F.get(bound, F.lit(0))


def _line(line: Column, paragraph: Column) -> Column:
    """A line as a paragraph to judge: told (the family of the notice that stands there) and same (its share) are null."""
    return F.struct(line.cast("int").alias("line"), paragraph.alias("paragraph"), line.cast("int").alias("last"), F.lit(None).cast("string").alias("told"), F.lit(None).cast("double").alias("same"))


def _judged(lines: DataFrame, model: LicenseModel) -> DataFrame:
    """lines with the column p, an array of struct(line, paragraph, last, told, same), given family and probability.

    family is the likeliest one, unknown left out, and probability its own among all; paragraphs without a single
    weighted feature are left out, as are those below the model's threshold.
    """
    kept = lambda p: [p[x].alias(x) for x in ("line", "paragraph", "last", "told", "same")]

    def prepare(p: Column) -> Column:
        return F.struct(*kept(p), _active(F.array_distinct(features(words(p["paragraph"]))), model).alias("active"))

    def judge(p: Column) -> Column:
        return F.struct(*kept(p), _told(p["active"], model).alias("judged"))

    def flat(p: Column) -> Column:
        return F.struct(*kept(p), p["judged"]["family"].alias("family"), p["judged"]["probability"].alias("probability"))

    lines = lines.withColumn("p", F.transform("p", prepare))
    lines = lines.withColumn("p", F.transform(F.filter("p", lambda p: F.size(p["active"]) > 0), judge))
    return lines.withColumn("p", F.transform(F.filter("p", lambda p: p["judged"]["probability"] >= model.threshold), flat))


def license_paragraphs(docs: DataFrame, model: LicenseModel, gate: bool = True) -> DataFrame:
    """doc_id, n_paragraphs and licenses (array of line, paragraph, family, probability, similarity) of each row of docs (doc_id, text).

    gate: leave texts without any needed word unjudged, which changes no answer.
    """
    text = F.coalesce("text", F.lit(""))
    split = F.transform(F.split(text, "\n"), lambda p, i: _line(i, p))
    none = F.array().cast("array<struct<line:int,paragraph:string,last:int,told:string,same:double>>")
    every = F.concat(split, _wrapped(text))
    told = F.when(may_hold(text), every).otherwise(none) if gate else every
    lines = docs.select("doc_id", F.size(F.split(text, "\n")).cast("bigint").alias("n_paragraphs"), told.alias("p"))
    lines = _judged(lines, model)

    def confirm(p: Column) -> Column:
        same = F.when(p["told"].isNull(), F.when(p["paragraph"].rlike(NEGATED), 0.0).otherwise(_similarity(words(p["paragraph"]), p["family"]))).when(p["told"] == p["family"], p["same"]).otherwise(0.0)
        return F.struct(p["line"].alias("line"), p["paragraph"].alias("paragraph"), p["family"].alias("family"), p["probability"].alias("probability"), same.alias("similarity"), p["last"].alias("last"), p["told"].isNull().alias("plain"), (p["last"] < p["line"]).alias("phrase"))

    found = F.filter(F.transform("p", confirm), lambda p: p["similarity"] >= CONFIRM_AT)
    lines = lines.select("doc_id", "n_paragraphs", found.alias("found"))

    def once(found: Column) -> Column:
        """Lines; windows that no line tells of already; phrases of a family that nothing else tells of."""
        own = lambda x: F.exists(found, lambda p: p["plain"] & p["line"].between(x["line"], x["last"]) & ((p["family"] == x["family"]) | (p["similarity"] >= x["similarity"])))
        first = lambda x: ~F.exists(found, lambda p: (p["family"] == x["family"]) & ~p["phrase"])
        kept = F.filter(found, lambda x: F.when(x["plain"], True).when(x["phrase"], first(x)).otherwise(~own(x)))
        return F.transform(kept, lambda x: F.struct(*(x[c].alias(c) for c in ("line", "paragraph", "family", "probability", "similarity"))))

    return lines.select("doc_id", "n_paragraphs", F.get(F.transform(F.array("found"), once), F.lit(0)).alias("licenses"))


def _wrapped(text: Column) -> Column:
    """Paragraphs to judge beside the lines: wrapped notices, short notices and titles, with told, the family of the notice there.

    A long notice is there where a window of its length and a quarter has CONFIRM_AT of its distinct words; the
    best notice wins, and overlapping windows of a family are one. A short notice or a title that stands there word by word
    is a phrase; its last line is the one before its own, as it is no line and no window.
    """
    long, exact = [], []
    for family, notices in NOTICES.items():
        for notice in notices:
            own = own_words(notice)
            if len(set(own)) >= LONG_NOTICE:
                step = -(-len(own) // 4)
                long.append({"family": family, "words": list(dict.fromkeys(own)), "step": step, "span": len(own) + step})
            else:
                exact.append((family, own, False))
    exact += [(family, re.findall(r"[\w.]+", title.lower()), True) for family, titles in TITLES.items() for title in titles]
    table = F.from_json(F.lit(json.dumps(long)), "array<struct<family:string,words:array<string>,step:int,span:int>>")
    stem = "^(" + "|".join(STEMS) + ")"

    def at_cell(own: Column, cell: Column) -> Column:
        def at(n: Column, k: Column) -> Column:
            start = F.greatest(F.lit(0), cell + 3 - k * n["step"])
            share = F.size(F.array_intersect(F.slice(own, start + 1, n["span"]), n["words"])) / F.size(n["words"])
            return F.struct(share.alias("share"), n["family"].alias("family"), start.alias("start"), n["span"].alias("span"), cell.alias("cell"))

        return F.array_max(F.flatten(F.transform(table, lambda n: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: at(n, k)))))

    def windows(placed: Column) -> Column:
        def found(own: Column) -> Column:
            cells = F.array_distinct(F.filter(F.transform(own, lambda w, i: F.when(w.rlike(stem), i - F.pmod(i, F.lit(4)))), lambda i: i.isNotNull()))
            return F.filter(F.transform(cells, lambda c: at_cell(own, c)), lambda h: h["share"] >= CONFIRM_AT)

        def entry(own: Column, h: Column) -> Column:
            part = F.slice(placed, h["start"] + 1, h["span"])
            paragraph = F.array_join(F.slice(own, h["start"] + 1, h["span"]), " ")
            return F.struct(F.get(part, F.lit(0))["line"].alias("line"), paragraph.alias("paragraph"), F.element_at(part, -1)["line"].alias("last"), h["family"].alias("told"), h["share"].alias("same"))

        def apart(hits: Column) -> Column:
            again = lambda x: F.exists(hits, lambda h: (h["family"] == x["family"]) & (h["cell"] < x["cell"]) & (h["cell"] + h["span"] > x["cell"]))
            return F.filter(hits, lambda x: ~again(x))

        own = F.transform(placed, lambda x: x["word"])
        bound = F.transform(F.array(own), lambda own: F.flatten(F.transform(F.array(found(own)), lambda hits: F.transform(apart(hits), lambda h: entry(own, h)))))
        return F.flatten(bound)

    def phrase(words_: list[str], title: bool) -> str:
        inner = r"[^\p{L}\p{N}]+".join(map(re.escape, words_))
        return rf"(?im)^[^\p{{L}}\p{{N}}\n]*{inner}[^\p{{L}}\p{{N}}\n]*$" if title else rf"(?i)(?<![\p{{L}}\p{{N}}]){inner}(?![\p{{L}}\p{{N}}])"

    placed = F.flatten(F.transform(F.split(text, "\n"), lambda l, i: F.transform(words(l), lambda w: F.struct(w.alias("word"), i.alias("line")))))
    found = F.get(F.transform(F.array(placed), lambda placed: windows(placed)), F.lit(0))
    kinds: dict[str, list[str]] = {}
    for family, own, title in exact:
        kinds.setdefault(family, []).append(phrase(own, title))
    more = []
    for family, patterns in kinds.items():
        hit = F.lit("(?:" + "|".join(f"(?:{x})" for x in patterns) + ")")
        line = F.size(F.split(F.substring(text, F.lit(1), F.regexp_instr(text, hit)), "\n")) - 1
        there = F.regexp_extract(text, "(?:" + "|".join(f"(?:{x})" for x in patterns) + ")", 0)
        entry = F.struct(line.cast("int").alias("line"), there.alias("paragraph"), (line - 1).cast("int").alias("last"), F.lit(family).alias("told"), F.lit(1.0).alias("same"))
        more.append(F.when(F.regexp_like(text, hit), entry))
    named = F.filter(F.array(*more), lambda x: x.isNotNull())
    return F.concat(found, F.filter(named, lambda x: ~F.coalesce(_before(text, x["paragraph"]).rlike(NEGATED), F.lit(False))))


def _before(text: Column, phrase: Column) -> Column:
    """The phrase with what stands up to 40 characters before it, on its line."""
    at = F.instr(text, phrase)
    return F.element_at(F.split(F.substring(text, F.greatest(at - 40, F.lit(1)), F.least(at - 1, F.lit(40)) + F.length(phrase)), "\n"), -1)


def license_scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """A row for each row of docs: n_paragraphs (lines), n_license (lines, and wrapped notices), families in order, the best probability and similarity.

    Null and empty texts are one line without a licence. Repeated rows, ties and null ids each keep their row, as
    the lines stay in theirs: nothing is shuffled; a very long text is scanned whole, in its row. Other columns are not read;
    an empty table gives an empty one.
    """
    best = lambda name: F.coalesce(F.array_max(F.transform("licenses", lambda p: p[name])), F.lit(0.0)).alias(name)
    return license_paragraphs(docs, model).select(
        "doc_id",
        "n_paragraphs",
        F.size("licenses").cast("bigint").alias("n_license"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda p: p["family"]))), ",").alias("families"),
        best("probability"),
        best("similarity"),
    )


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return license_scan(docs, fit(docs))
