"""Radix tries and source divergence against plain versions and SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodeflow.llm import divergence as D
from lodeflow.llm.term_tries import Trie, shared_depths

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows, least, top):
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", n or "", s or "") for t, n, s in rows):
        found = TERM.findall(lower(text))
        groups[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)
        v = len(kept)
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * v)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: share(own[s][t], sum(own[s].values())) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    words = ["a", "ab", "abc", "abd", "b", "ba", "é", "éa", "zürich", "ZÜRICH", "Abc", "the", "漢字", "x" * 300, "x" * 299 + "y", "\U0001f600"]
    made = [(" ".join(draw.choices(words, k=draw.randrange(12))) + draw.choice(["", ".", "-ab_c1d"]), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", None])) for _ in range(120)]
    return made + [(None, "fr", "s1"), ("", "fr", "s2"), ("lone words", "xx", "only"), ("the " * 20000, "en", "long")] + made[:5]


@pytest.mark.parametrize(("branch", "held"), [(1 << 18, 2_000_000), (40, 60), (1, 1)])
def test_against_a_plain_version(spark, rows, branch, held):
    """Branches are cut down to single terms, and these merged in shares, without any change."""
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "text string, lang string, source string, item string, value int").repartition(5)
    assert got(D.source_divergence(docs, 3, 4, branch, held)) == plain(rows, 3, 4)


def test_query_is_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = got(D.op11_source_divergence(spark, sf))
    assert found == sorted(con.execute(D.OP11_SQL).fetchall()) and {r[2] for r in found} == {"pair", "term"}


def test_empty_table(spark):
    assert D.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_tries_pack_merge_and_branch():
    draw = random.Random(8)
    for _ in range(20):
        terms = [bytes(draw.choices(b"ab\xc3", k=draw.randrange(1, 7))) for _ in range(draw.randrange(1, 60))]
        docs = np.array([draw.randrange(1, 9) for _ in terms])
        leaf = np.repeat(np.arange(len(terms)), 2)
        sources, counts = np.array([draw.randrange(3) for _ in leaf]), np.array([draw.randrange(1, 9) for _ in leaf])
        trie = Trie.grown(pa.array(terms, pa.large_binary()), docs, leaf, sources, counts)
        want = defaultdict(Counter)
        for i, s, c in zip(leaf, sources, counts):
            want[terms[i]][int(s)] += int(c)
        listed = lambda t: [(w, {int(t.sources[k]): int(t.counts[k]) for k in range(t.ptr[i], t.ptr[i + 1])}) for i, w in enumerate(t.terms.to_pylist())]
        assert listed(trie) == [(w, dict(want[w])) for w in sorted(want)]
        back = Trie.unpacked(trie.packed())
        assert listed(back) == listed(trie) and back.docs.tolist() == trie.docs.tolist() and int(back.docs.sum()) == int(docs.sum())
        cut = trie.branches(2)
        assert [a for _, a, _ in cut] + [len(trie)] == [0] + [b for _, _, b in cut]
        assert all({w[:2] for w in trie.terms.slice(a, b - a).to_pylist()} == {prefix} for prefix, a, b in cut) and len({x for x, _, _ in cut}) == len(cut)
        parts = [Trie.unpacked(trie.leaves(a, b).packed()) for _, a, b in cut]
        draw.shuffle(parts)
        assert listed(Trie.merged(parts)) == listed(trie)
        twice = Trie.merged([trie, back])
        assert twice.docs.tolist() == (2 * trie.docs).tolist() and twice.counts.tolist() == (2 * trie.counts).tolist()


def test_depths_of_very_long_terms():
    data = np.frombuffer(b"a" * 5000 + b"a" * 4999 + b"b", np.uint8)
    assert shared_depths(data, np.array([0, 5000, 10000])).tolist() == [0, 4999]


def test_shares_are_exact():
    draw = random.Random(9)
    for _ in range(300):
        total = draw.randrange(5, 9 * 10**17)
        count = draw.randrange(0, total - 4)
        assert D.share(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * (count + 5) // total]
