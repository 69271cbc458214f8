"""Jaccard components, language model, packing, pieces and licences against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeflow.llm import license_scan, lm_scoring, packing, piece_encoding, quality_classifier, quality_rules
from lodeflow.llm.ngram_jaccard import jaccard_components
from lodeflow.llm.words import Texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute_components(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    return sorted(((d, len(s), min((x for x in ids[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed):
    """Chains of copies, each with more words changed, round bases that share passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 4) + rng.choice(["x", "Y", "é"])
    passage = " ".join(word() for _ in range(30))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(6, 120))]
        if rng.random() < 0.5:
            base = passage.split() + base
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rows += ["", None, " \n", "one", "ONE", "one two three", "one two  three", "one two", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    ids = rng.sample(range(1000), len(rows))
    found = list(zip(ids, rows, strict=True))
    return [*found, found[3], (None, found[5][1]), (None, "alone by itself it stands here")]


@pytest.mark.parametrize(
    ("seed", "size", "percent", "frequent_sets"), [(0, 4, 85, 1000), (1, 4, 85, 2), (2, 5, 80, 3), (2, 5, 80, 1000), (3, 2, 60, 4), (4, 4, 100, 1000)]
)
def test_components_match_all_pairs(spark, seed, size, percent, frequent_sets):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_shingles int, component_id string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, size, percent, frequent_sets).collect()), key=str)
    assert found == brute_components(rows, size, percent)


def test_components_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    for texts in (["", None], ["a b c d e", "f g h i j k"], ["lone", None]):  # no n-gram, or none that two share
        rows = list(enumerate(texts))
        found = sorted((tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
        assert found == brute_components(rows, 4, 85)


def lm_rows(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "dog", "sat", "ran", "on", "mat", "far", "away"]
    rows = [(i, " ".join(rng.choice(words) if k % 3 else "on the" for k in range(rng.randrange(1, 40)))) for i in range(150)]
    return [*rows, (150, ""), (151, None), (None, "cat sat"), (7, "unknown words only")]


def test_no_link_is_lost_in_large_arrow_batches(spark):
    """More rows in one Arrow batch than a chunk may hold: places within a chunk must not wrap. Copies lie in different chunks."""
    n, pairs = 160_000, 60
    rows = [(i, f"{i % 997} {i}") for i in range(n)]
    for k in range(pairs):
        long = [f"p{k}q{j}" for j in range(30)]
        for i, text in ((k * 1300, long), (k * 1300 + 80_000, [*long[:-1], "other"])):
            rows[i] = (i, " ".join(text))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "200000")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(2, "doc_id")
        found = {r.doc_id: r.component_id for r in jaccard_components(df, 4, 85).where("component_id <> doc_id").collect()}
    finally:
        spark.conf.set(key, before)
    assert all(found.get(k * 1300 + 80_000) == k * 1300 for k in range(pairs))


def test_lm_base_and_paths(spark):
    rows = lm_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", lm_scoring.held_out_column().alias("held_out"))
    model = lm_scoring.fit(docs.where("NOT held_out"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = [[*WORD.findall(lower(t)), "\n"] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    pairs = Counter(p for (i, _), ws in zip(rows, tokens, strict=True) if not held(i) for p in zip(["\n", *ws], ws, strict=False))
    n, v = sum(counts.values()), len(counts)
    assert (model.n_tokens, model.n_words) == (n, v)
    found = lm_scoring.score(docs, model).collect()
    exact, own = [], []
    for r, (i, _), ws in zip(found, rows, tokens, strict=True):
        base = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
        assert r.doc_id == i and r.held_out == held(i) and r.n_tokens == len(ws) and r.n_known == sum(counts[w] > 0 for w in ws) and r.train_tokens == n
        assert abs(r.base_score - sum(math.log10(base(w)) for w in ws)) < 1e-9 * max(1, abs(r.base_score))
        exact.append(sum(math.log10((pairs[p] + model.k * base(p[1])) / (counts[p[0]] + model.k)) for p in zip(["\n", *ws], ws, strict=False)))
        own.append(r.score)
    assert abs(np.sum(own) - np.sum(exact)) < 0.05 * abs(np.sum(exact))
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # levels and false answers move a text's score by less than 0.05 a token from that of exact pair counts
    assert max(abs(a - b) / r.n_tokens for a, b, r in zip(own, exact, found, strict=True)) < 0.05
    for head in (1, 40, lm_scoring.HEAD):  # no word, some words, every word is frequent
        joined = sorted(lm_scoring.score(docs, model, max_broadcast_bytes=0, head=head).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
        for a, b in zip(sorted(found, key=lambda r: (str(r.doc_id), r.n_tokens)), joined, strict=True):
            assert a[:5] == b[:5] and abs(a.score - b.score) < 1e-9 * max(1, abs(a.score)) and abs(a.base_score - b.base_score) < 1e-9 * max(1, abs(a.base_score))


def test_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 30000, dtype=np.uint64))
    counts = rng.integers(1, 200, len(keys))
    table = lm_scoring.Lookup(np.zeros(0, np.uint64), np.zeros(0, np.uint32), lm_scoring._piece(keys, counts), np.zeros(64, np.uint64), np.zeros(64, np.uint64), 6)
    table.width[:] = len(table.filter)
    want = lm_scoring.levels_of(counts)
    got = table.level(keys)
    assert (got >= want).all() and (got == want).mean() > 0.95
    other = rng.integers(1 << 63, (1 << 64) - 1, 20000, dtype=np.uint64)
    assert (table.level(other) > 0).mean() < 0.06


def test_lm_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    model = lm_scoring.fit(empty)
    assert lm_scoring.score(empty, model).count() == 0
    one = spark.createDataFrame([(1, "a b", True)], empty.schema)
    r = lm_scoring.score(one, model).first()
    assert r.n_tokens == 3 and r.n_known == 0 and abs(r.score - r.base_score) < 1e-12


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(0)
    odd = ["", None, "<|endoftext|> end", "don't !'s 12ab#", "Œuvre ½ É\x1cb\x85c", "x" * 9000, "word " * 9000]
    rows = [*enumerate(odd), *((10 + i, " ".join(rng.choice(["Été", "tree,", "running", "a1"]) for _ in range(rng.randrange(900)))) for i in range(60)), (10, "again"), (None, "null id")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int")
    found = packing.pack(df, packing.public_tokenizer(), capacity=512, group_docs=20, with_ids=True).toPandas()
    plain = Tokenizer.from_file(packing.public_tokenizer())
    want = Counter(tuple([*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    got = Counter()
    for key, part in found.assign(doc_id=found.doc_id.fillna(-1)).groupby(["doc_id", "doc_tokens"]):
        part = part.sort_values("start")
        assert part.start.tolist() == np.cumsum([0, *part.length])[:-1].tolist() and part.length.sum() == key[1]
        got[tuple(int(x) for b in part.ids for x in np.frombuffer(b, "<u4"))] += 1
    assert got == want
    assert all(zlib.crc32(b) == c for b, c in zip(found.ids, found.ids_crc32, strict=True))
    for _, part in found.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == np.cumsum([0, *part.length])[:-1].tolist() and part.length.sum() <= 512
    assert packing.pack(df.limit(0), packing.public_tokenizer()).count() == 0


def test_odd_strings_are_tokenised_alike():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    bits = ["a", "B", "c", "'s", "'LL", "é", "É", "ß", "ÿ", "÷", "×", "1", "23", "!", "...", "<|", "|>", "<|endoftext|>", " ", "\n", "\t", "\x0b", "\xa0", "ı", "İ", "ſ", "\u212a", "日本", "e\u0301", "\u2028", "\x00", "\x1c", "½", "ª", "µ", "don't", "😀", "_", "-", "'", "''", "\u212b", "A\u030a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(60_000)]
    ours, plain = packing.WordTokenizer(packing.public_tokenizer()), Tokenizer.from_file(packing.public_tokenizer())
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        want = plain.encode_batch(some, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode([t.encode() for t in some])] == [w.ids for w in want]


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 300):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free = []
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if k == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - free[k])
            free[k] -= lengths[i]


def brute_segment(model, text):
    """Best score over all segmentations, by dynamic programming over every substring."""
    pieces = {piece: (i, s) for piece, (i, _, s) in model.automaton.items()}
    longest = max(map(len, pieces))
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + model.fallback
        for start in range(max(0, end - longest), end):
            if text[start:end] in pieces:
                best[end] = max(best[end], best[start] + pieces[text[start:end]][1])
    return best[-1]


def test_pieces(spark):
    model = piece_encoding.piece_model(piece_encoding.public_pieces())
    rng = random.Random(2)
    texts = ["", None, " ", "Hello  world\n", "▁ written", "日本語 \U0001f600 é\u0301", "a\nb\n\n c  ", "\x00 nul"]
    texts += ["".join(rng.choice("ab é.\n ") + rng.choice(["ing", "tion", "", "the"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in piece_encoding.encode(df, piece_encoding.public_pieces()).collect()}
    assert all(r.round_trip for r in found.values())
    for i, t in enumerate(texts):
        ids = found[i].ids
        assert model.decode(ids) == (t or "") and len(ids) == found[i].n_ids
        if t:
            plain = (" " + t).replace("▁", "\0").replace(" ", "▁")
            unknown = sum(1 for c in plain if not model.automaton.exists(c))
            best = brute_segment(model, plain)
            assert abs(found[i].score + unknown * model.fallback - best) < 1e-6 * abs(best) + 1e-6
    back = {r.doc_id: r.text for r in piece_encoding.decode(piece_encoding.encode(df, piece_encoding.public_pieces()), piece_encoding.public_pieces()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_pieces_of_many_parts_take_their_steps_together(monkeypatch):
    """Few parts go one by one, whatever their number, and all get the ids that they get alone; so does each text after a cache is forgotten."""
    model = piece_encoding.PieceModel(piece_encoding.public_pieces())
    rng = random.Random(4)
    pieces = [p.replace("▁", " ") for p, _ in model.automaton.items()]
    odd = ["日本語", "\U0001f600", "é\u0301", "▁", "\x00", "\n", "\t", "    ", " "]
    parts = {"".join(rng.choice(pieces if rng.random() < 0.6 else odd) for _ in range(rng.randrange(1, 9))) for _ in range(3000)}
    texts = ["", *sorted(parts), " ".join(sorted(parts)), "x" * 5000, "▁" * 200, ""]
    alone = model.segment
    walks = []
    monkeypatch.setattr(model, "segment", lambda part: walks.append(part) or alone(part))
    wanted = [[i for part in model.split.findall(" " + t) for i in alone(part)] if t else [] for t in texts]
    for limit in (10**9, 1000):
        monkeypatch.setattr(piece_encoding, "_CACHE_POINTS", limit)
        model.forget()
        walks.clear()
        ids, n = model.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == wanted
        assert len(walks) <= 64 and len(model.known) > 3000
        assert model.spell(ids) == b"".join(b" " + t.encode() for t in texts if t)
    ids, n = model.encode(texts[:9])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == wanted[:9] and len(model.known) < 100


def test_licences(spark):
    plain = ["the river runs over stones", "a free walk in the park under trees", "license plates are yellow here", "", "version 2 of the song"]
    rows = [(i, plain[i % 5] + "\n" + plain[(i + 1) % 5]) for i in range(40)]
    rows += [(100, "text\nReleased under the MIT License.\nmore"), (101, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (102, None), (103, ""), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, families string")
    model = license_scan.fit(df)
    found = {r.doc_id: r for r in license_scan.license_scan(df, model).collect()}
    assert len(found) == len(rows)
    assert (found[100].families, found[101].families, found[None].families) == ("mit", "apache,mit", "cc")
    assert all(found[i].n_license == 0 for i in [*range(40), 102, 103]) and found[100].n_paragraphs == 3
    assert all(r.probability >= license_scan.LEAST_PROBABILITY for r in found.values() if r.n_license)
    assert license_scan.license_scan(df.limit(0), license_scan.fit(df.limit(0))).count() == 0


WRAPPED = {
    "mit": "MIT License\n\nCopyright (c) 2020 A B\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n",
    "bsd": "BSD 3-Clause License\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n",
    "apache": "Licensed under the Apache License, Version 2.0\n(the \"License\"); you may not use this file except\nin compliance with the License.\n",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n",
    "isc": "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without fee is hereby\ngranted, provided that the above copyright notice and this\npermission notice appear in all copies.\n",
    "cc": "Licensed under\nCC BY-NC 4.0.",
    "zlib": "words\nThe text is licensed under the\nzlib License.",
    "epl": "Eclipse Public License\n",
}


def test_wrapped_licences(spark):
    prose = ["the river runs over stones and", "you may not copy this, any person", "license plates are yellow here under", "permission to walk in the park", "copyright is a word"]
    rows = [(f"plain{i}", "\n".join(prose[(i + k) % 5] for k in range(4))) for i in range(20)]
    rows += [("plain album", "The new album was released under the MIT label and the license was refused.")]
    rows += [(k, "before it, prose\n" + t + "after it, prose") for k, t in WRAPPED.items() if k not in ("cc", "epl")] + [(k, WRAPPED[k]) for k in ("cc", "epl")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = {r.doc_id: r for r in license_scan.license_scan(df, license_scan.fit(df)).collect()}
    assert {k: found[k].families for k in WRAPPED} == {k: k for k in WRAPPED}
    assert all(r.n_license == 0 for k, r in found.items() if k.startswith("plain"))


WARRANTY = "Unless required by applicable law or agreed to in writing, software distributed under this is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."


def test_licences_without_the_gate_are_the_same(spark):
    """The words that the gate asks for follow from the rule of confirmation: judging every text gives the same answers."""
    prose = ["the river runs over stones and", "software is distributed as it is", "conditions of any kind, under law", "", "walks are free of charge"]
    notices = [" ".join(n.split()[k:]) for every in license_scan.NOTICES.values() for n in every for k in (0, len(n.split()) // 4)]
    titles = [t for every in license_scan.TITLES.values() for t in every]
    rows = [(i, text) for i, text in enumerate([*prose * 4, *notices, *titles, WARRANTY, WARRANTY.replace(" distributed", "\ndistributed"), "This tale is not licensed under the MIT license, nor is it free."])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = license_scan.fit(df.where("doc_id < 20"))
    gated, every = (sorted(map(tuple, license_scan.license_paragraphs(df, model, gate).collect()), key=str) for gate in (True, False))
    assert gated == every
    found = {r.doc_id: r.families for r in license_scan.license_scan(df, model).collect()}
    assert "apache" in found[rows[-3][0]] and found[rows[-1][0]] == ""
    hit = [f for f, ns in license_scan.NOTICES.items() for n in ns for _ in (0, 1)]
    right = sum(f in found[20 + j].split(",") for j, f in enumerate(hit) if j % 2 == 0)
    assert right >= 0.9 * len(hit) / 2


def test_licence_probabilities_are_the_models(spark):
    """Each probability is the regression's own, by hand from its weights; also that of wrapped notices and titles."""
    import math
    import re

    rows = [(i, "the river runs over stones and walks") for i in range(30)] + [(100, WRAPPED["mit"]), (101, WRAPPED["zlib"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = license_scan.fit(df)
    told = [p for r in license_scan.license_paragraphs(df, model).collect() for p in r.licenses]
    grams = {}
    for p in told:
        w = [x for x in re.split(r"[^\w.]+|\.(?=\s|$)", p.paragraph.lower()) if x]
        grams[p.paragraph] = [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
    flat = sorted({g for gs in grams.values() for g in gs})
    bucket = {r.g: r.b for r in spark.createDataFrame([(g,) for g in flat], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(license_scan.BUCKETS)).alias("b")).collect()}
    assert told
    for p in told:
        logits = [b + sum(w[i] for i in {bucket[g] for g in grams[p.paragraph]}) for b, w in zip(model.biases, model.weights)]
        assert abs(p.probability - math.exp(max(logits[:-1])) / sum(map(math.exp, logits))) < 1e-6 and model.families[logits.index(max(logits[:-1]))] == p.family


def test_licence_model_learns_from_every_line(spark):
    """Lines beyond the first thousands by hash change the weights, and those held out the threshold; FRAGMENT_PAIRS decides by itself which lines are examples."""
    assert license_scan._least_pairs() >= license_scan.FRAGMENT_PAIRS
    line = F.concat(F.lit("the river runs "), F.col("id").cast("string"))
    pool = spark.range(6000).select(line.alias("text")).withColumn("rank", F.xxhash64("text")).orderBy("rank").collect()
    cut = pool[4500].rank
    more = spark.range(4000).select(F.concat(F.lit("license of software "), F.col("id").cast("string")).alias("text")).where(F.xxhash64("text") > cut).collect()
    near, all_ = ["\n".join(r.text for r in rows) for rows in (pool[:4500], [*pool[:4500], *more])]
    assert len(more) > 300
    few, whole = (license_scan.fit(spark.createDataFrame([(1, t)], "doc_id long, text string")) for t in (near, all_))
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit("software")), F.lit(license_scan.BUCKETS)).alias("b")).first().b
    assert whole.weights[-1][bucket] > few.weights[-1][bucket]


def test_licence_threshold_counts_every_line_held_out(spark):
    model = license_scan.LicenseModel(["mit", "unknown"], [0.0, 0.0], [[0.0, 1.0, 2.0, *[0.0] * (license_scan.BUCKETS - 3)], [0.0] * license_scan.BUCKETS], 0.5)
    at = lambda *counts: license_scan._threshold(spark.createDataFrame([([b],) for b, n in enumerate(counts) for _ in range(n)], "buckets array<int>"), model)
    assert at(5000, 0, 0) == at(5000, 1, 1) == 0.5  # in 5002 lines five may reach it
    assert abs(at(5000, 20, 3) - 0.7311) < 1e-9 and abs(at(5000, 20, 9) - 0.8808) < 1e-9


def test_licence_gate_and_plan_are_small(spark):
    """The gate's pattern knows the needed words, whole and no others; the plan's text, which the driver holds in many copies, stays short."""
    needed = license_scan.needed()
    words = [*needed, *(w[:-1] for w in needed), *(w + "x" for w in needed), *(f"({w.upper()})" for w in needed)]
    found = {r.w: r.hit for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", license_scan.may_hold(F.col("w")).alias("hit")).collect()}
    assert found == {w: w.strip("()").lower() in needed for w in words}
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    weights = [[0.25 if i % 16 == 0 else 0.0 for i in range(license_scan.BUCKETS)] for _ in range(14)]
    plan = license_scan.license_scan(df, license_scan.LicenseModel([*license_scan.NOTICES, "unknown"], [0.0] * 14, weights, 0.5))
    assert len(plan._jdf.queryExecution().toString()) < 1_000_000


def test_licence_gate_and_lines_do_no_work_twice(spark):
    """The gate's pattern reads only texts with the words; a paragraph is split once for its features; both, and the training lines, are as by hand."""
    odd = ["", "LICENSE", "élicense", "license\u0301", "license\U0001d400", "_license_", "licenſe", "the\nlicense.", "4.0", "v4.0", "(4.0)", "4 0", "4.01", "lice nse", "İunder", "1under", "ünder", "un-der, \u2028under\u00a0", "公under", "公 under", "SPDX:", "re\u00adleased"]
    some = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, license_scan.needed())) + r")(?![^\W_])")
    gate = spark.createDataFrame([(t,) for t in odd], "text string").select("text", license_scan.may_hold(F.col("text")).alias("hit"))
    assert {r.text: r.hit for r in gate.collect()} == {t: bool(some.search(t.lower())) for t in odd}
    plan = gate._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("arrays_overlap") < plan.find("RLIKE")
    split = gate.select(license_scan.features(license_scan.words(F.col("text"))).alias("b"))
    assert split._jdf.queryExecution().analyzed().toString().count("split(lower(") == 1

    notices = [license_scan.own_words(n) for every in license_scan.NOTICES.values() for n in every]
    lines = ["", "a", "the river runs. The river, it runs", "free of charge", "is free of charge to any person", "Permission is hereby granted", "permission is hereby", "of charge of charge of charge", *odd[1:5], "Released under the MIT License"]
    grams = {}
    for line in lines:
        w = license_scan.own_words(line)
        if max(len(set(zip(w, w[1:])) & set(zip(n, n[1:]))) for n in notices) < license_scan.FRAGMENT_PAIRS:
            grams[line] = [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]
    flat = spark.createDataFrame([(g,) for g in {g for gs in grams.values() for g in gs}], "g string")
    bucket = {r.g: r.b for r in flat.select("g", F.pmod(F.xxhash64("g"), F.lit(license_scan.BUCKETS)).alias("b")).collect()}
    want = sorted(sorted({bucket[g] for g in gs}) for gs in grams.values())
    docs = spark.createDataFrame([("\n".join(lines),), (lines[2],), (None,)], "text string")
    found = license_scan._lines(docs, list(range(license_scan.BUCKETS))).collect()
    assert sorted(sorted(r.buckets) for r in found) == want and len(want) < len(lines) - 2


def test_licence_plan_is_native(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = license_scan.license_scan(df, license_scan.LicenseModel(["mit", "unknown"], [0.0, 0.0], [[0.1] * license_scan.BUCKETS, [0.0] * license_scan.BUCKETS], 0.5))
    assert not re.search("Python|Arrow|Pandas|Exchange", plan._jdf.queryExecution().executedPlan().toString())
    assert plan.select(F.col("n_license")).first()[0] == 1


def plain_votes(text):
    """The nine labellers, each from its definition."""
    words, data = WORD.findall(lower(text)), text.encode()
    if not words:
        return [-1] * 9
    n, distinct = len(words), len(set(words))
    letters = sum(b >= 128 or chr(b).isalpha() for b in data)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(n - 4)]
    twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    vote = lambda value, good, bad: 1 if value <= good else -1 if value >= bad else 0
    return [
        vote(sum(c in "#*$%&|<>" for c in text) / len(data), 0.01, 0.05),
        vote(sum("A" <= c <= "Z" for c in text) / max(letters, 1), 0.10, 0.35),
        vote(-distinct / n, -0.45, -0.20),
        vote(len(twice) / n, 0.10, 0.30),
        vote(sum(c in "!|" for c in text) / n, 0.05, 0.30),
        vote(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 0.02, 0.20),
        vote(-letters / len(data), -0.70, -0.55),
        0 if len(lines) < 3 else vote((len(lines) - len(set(lines))) / len(lines), 0.2, 0.6),
        vote(-distinct / max(n / math.log(max(n, 2)), 1), -1.2, -0.5),
    ]


def test_votes_and_posterior_by_hand(spark, sf):
    rng = random.Random(7)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += [" ".join(rng.choice(["A", "bb", "BB", "é!", "||", "1 2", "x\nx", "\n"]) for _ in range(rng.randrange(40))) for _ in range(80)]
    texts += ["", " \n", "one", "a b c d e a b c d e"]
    want = [plain_votes(t) for t in texts]
    assert quality_classifier.votes(Texts.of(pa.array(texts))).T.tolist() == want
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    model = quality_classifier.fit(df)
    for r in quality_classifier.quality_classifier(df, model).collect():
        good, bad = model.labels.prior, 1 - model.labels.prior
        for labeller, v in enumerate(want[r.doc_id]):
            good, bad = good * model.labels.chances[labeller, 1, v + 1], bad * model.labels.chances[labeller, 0, v + 1]
        assert (r.votes_good, r.votes_bad) == (want[r.doc_id].count(1), want[r.doc_id].count(-1)) and abs(r.posterior - good / (good + bad)) < 1e-9


def test_quality_rules_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs, quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))).collect()}
    out = [(found[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([r.kept for r, q in out if q == 1 and not r.base_failed]) > 0.9 and np.mean([r.kept for r, q in out if q == 0]) < 0.2
