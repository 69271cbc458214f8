"""Runs of words against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from lodeflow.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """All runs (start, end, period) of a list of words, by the definition."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)  # the smallest period comes first
            i = j
    return sorted((s, e, p) for (s, e), p in found.items())


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = {i for s, e, p in runs for i in range(s + p, e)}
    best = min(runs, key=lambda r: (-(r[1] - r[0]), r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    told = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    return (doc_id, len(runs), *four, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def run_of(sequences, block=P.BLOCK):
    ids = np.array([x for s in sequences for x in s], np.int64)
    bounds = np.cumsum([0] + [len(s) for s in sequences])
    found = P.find_runs(ids, bounds, block)
    return [[(s - lo, e - lo, p) for s, e, p in found.tolist() if lo <= s < hi] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def test_random_sequences():
    draw = random.Random(1)
    for letters in (1, 2, 3, 5):
        sequences = []
        for _ in range(60):
            s = [draw.randrange(letters) for _ in range(draw.randrange(90))]
            for _ in range(draw.randrange(3)):
                at, p = draw.randrange(len(s) + 1), draw.randrange(1, 9)
                s[at:at] = [draw.randrange(letters) for _ in range(p)] * draw.randrange(2, 8)
            sequences.append(s)
        for block in (7, 300, P.BLOCK):
            for got, s in zip(run_of(sequences, block), sequences):
                assert sorted(got) == brute(s)


def test_one_word_all_over_and_nested_runs():
    assert run_of([[4] * 5000], 1000) == [[(0, 5000, 1)]]
    inner = ([1] * 8 + [2]) * 5
    assert run_of([inner])[0] == sorted(brute(inner), key=lambda r: (r[0], r[2]))


def test_words_decide_where_hashes_lie(monkeypatch):
    """With hashes that call everything alike, comparing words still gives the runs."""
    monkeypatch.setattr(P._Hashes, "alike", lambda self, a, lag, n: np.ones(len(a), bool))
    draw = random.Random(2)
    for _ in range(40):
        s = [draw.randrange(3) for _ in range(40)] + [7, 8] * 6
        assert sorted(run_of([s])[0]) == brute(s)


def test_thue_morse_words_meet_no_false_run():
    s = [0]
    while len(s) < 4096:
        s += [1 - x for x in s]
    assert run_of([s])[0] == []


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = P.op13_periodic_runs(spark, sf).select(*COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(expected(i, t) for i, t in docs)


def test_hostile_rows(spark):
    texts = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "a " * 30000, "x"), (4, "a " * 30000, "x"), (None, "b c " * 9, "x"), (6, "é ü " * 7 + "z", "x"), (49, "w " + "k l m " * 40, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, runs string")
    found = {(r.doc_id, r.n_words): r for r in P.periodic_runs(docs).collect()}
    assert found[1, 0].runs == found[2, 0].runs == found[3, 0].runs == [] and bytes(found[3, 0].collapsed) == b""
    assert [tuple(r) for r in found[4, 30000].runs] == [(0, 30000, 1)] and bytes(found[4, 30000].collapsed) == b"a"
    assert [tuple(r) for r in found[None, 18].runs] == [(0, 18, 2)] and bytes(found[None, 18].collapsed) == b"b c"
    assert [tuple(r) for r in found[6, 8].runs] == [(0, 7, 1)]
    assert P.periodic_runs(docs).count() == len(texts)
    assert P.digests(P.periodic_runs(P.looped(docs.where("false")))).count() == 0
    got = {r.doc_id: r for r in P.digests(P.periodic_runs(P.looped(docs.where("doc_id in (4, 49)").dropDuplicates()))).select(*COLUMNS).collect()}
    assert tuple(got[49]) == expected(49, texts[-1][1])
