"""How the sources of a language differ in their terms, counted in mergeable radix tries.

1. Each partition counts its terms in one byte trie for each language, with document counts and a counter for each
   source at the leaves. Tries are cut into subtrees by their first bytes.
2. Subtrees meet by prefix. A branch that is light as a whole is merged as one; a heavy one is cut deeper, byte by byte,
   until none is heavy. A single term that is still too heavy is merged in shares first. So what a task merges is bounded.
3. Terms in enough documents are kept. Their number and their counts by source and language are added up.
4. Traversed in the order of UTF-8 bytes, the merged tries give sums for each pair of sources, and each source's strongest
   terms; of equal ones those that come first stay. Sums and ranks of what all branches found are made by Spark.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeflow.llm.term_tries import Trie, _binary
from lodeflow.llm.words import Texts, release, running, slices
from lodeflow.session import bound_batches, materialize

#: A term is kept in a language with so many documents that hold it; a group's terms are told up to this rank.
LEAST_DOCS, TOP = 30, 50
#: Shares are in billionths, after so many counts are added to each term.
SCALE_DIGITS, ADDED = 9, 5
#: Leaves and counters of a partition's tries before they are sent, and of a branch that one task merges, about.
HELD, BRANCH = 2_000_000, 1 << 18
#: Bytes of text counted at once, bytes of the first cut, cells of a table of counts, and sources of one side of a tile of pairs.
COUNT_BYTES, FIRST_CUT, CELLS, TILE = 16 << 20, 2, 1 << 20, 512
_TERM = np.ones(256, bool)
_TERM[:128] = False
_TERM[97:123] = True

_PIECE = "lang string, prefix binary, deep boolean, n bigint, sources array<string>, trie binary"
_PIECE_NAMES = ["lang", "prefix", "deep", "n", "sources", "trie"]


def counted(texts: Texts, sources: np.ndarray) -> Trie:
    """The trie of texts that are lower-cased already; sources: the number of each text's source."""
    is_term = _TERM[texts.data]
    starts, ends = texts.spans(is_term)
    coded = _binary(texts.data[is_term], running(ends - starts)).dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, texts.offsets)))
    key, many = np.unique(text * max(len(words), 1) + code, return_counts=True)  # (text, term)
    of, term = np.divmod(key, max(len(words), 1))
    return Trie.grown(words, np.bincount(term, minlength=len(words)), term, sources[of], many)


def _pieces(lang: str, names: list[str], trie: Trie, depth: int) -> Iterator[tuple]:
    for prefix, low, high in trie.branches(depth):
        part = trie.leaves(low, high)
        used, number = np.unique(part.sources, return_inverse=True)
        part.sources = number
        yield lang, prefix, len(prefix) == depth, len(part) + len(part.counts), [names[i] for i in used.tolist()], part.packed()


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is binary, in batches of about most bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


_KINDS = [pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.binary()]


def local_tries(docs: DataFrame, held: int = HELD) -> DataFrame:
    """Subtrees of each partition's tries: lang, prefix, deep (whether it may hold more than the term prefix), n (leaves and counters), the sources' names and the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, list[Trie]] = {}
        known: dict[str, dict[str, int]] = {}

        def weight() -> int:
            return sum(len(t) + len(t.counts) for some in tries.values() for t in some)

        def sent() -> Iterator[pa.RecordBatch]:
            rows = (row for lang, some in tries.items() for row in _pieces(lang, list(known[lang]), Trie.merged(some), FIRST_CUT))
            yield from _batches(rows, _KINDS, _PIECE_NAMES)

        for batch in slices(batches, "text", COUNT_BYTES):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                rows = batch.filter(pc.equal(batch.column("lang"), lang))
                told = rows.column("source").dictionary_encode()
                own = known.setdefault(lang, {})
                number = np.array([own.setdefault(s, len(own)) for s in told.dictionary.to_pylist()], np.int64)
                trie = counted(Texts.of(rows.column("text")).lower(), number[told.indices.to_numpy()])
                if len(trie):
                    tries.setdefault(lang, []).append(trie)
            if weight() > held:
                tries = {lang: [Trie.merged(some)] for lang, some in tries.items()}
                if 2 * weight() > held:
                    yield from sent()
                    tries, known = {}, {}
        yield from sent()
        release()

    return docs.mapInArrow(run, _PIECE)


def _deeper(pieces: DataFrame, depth: int) -> DataFrame:
    """Each subtree cut at depth bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (piece for b in batches for r in b.to_pylist() for piece in _pieces(r["lang"], r["sources"], Trie.unpacked(r["trie"]), depth))
        yield from _batches(rows, _KINDS, _PIECE_NAMES)

    return pieces.select(*_PIECE_NAMES).mapInArrow(run, _PIECE)


def _united(table: pa.Table) -> tuple[list[str], Trie]:
    rows = table.select(["sources", "trie"]).to_pylist()
    names = sorted({s for r in rows for s in r["sources"]}, key=str.encode)
    at = {s: i for i, s in enumerate(names)}
    return names, Trie.merged([Trie.unpacked(r["trie"]).renumbered(np.array([at[s] for s in r["sources"]], np.int64)) for r in rows])


def merged_tries(docs: DataFrame, least_docs: int = LEAST_DOCS, branch: int = BRANCH, held: int = HELD) -> DataFrame:
    """lang, sources (names), totals (counts of kept terms by source), n_terms and trie, a row for each branch with kept terms."""
    pieces = materialize(local_tries(docs, held))
    ready: list[tuple[DataFrame, bool]] = []
    by = ["lang", "prefix", "deep"]
    total = lambda size: F.sum("n").over(Window.partitionBy("lang", F.substring("prefix", 1, size)))
    weights = pieces.groupBy(*by).agg(F.sum("n").alias("n"))  # of two bytes at first: a bounded table
    ahead = F.when(total(0) <= branch, 0).when(total(1) <= branch, 1).otherwise(FIRST_CUT)
    weights = materialize(weights.select(*by, F.col("n").alias("total"), ahead.alias("size")))
    depth = FIRST_CUT
    while True:
        heavy = (F.col("total") > branch) & (F.col("size") == depth)
        met = pieces.join(weights, by)
        key = F.when(F.col("size") < depth, F.substring("prefix", 1, F.col("size"))).otherwise(F.col("prefix"))
        deep = F.col("deep") | (F.col("size") < depth)
        lone = not weights.where(heavy & ~F.col("deep")).isEmpty()  # a single term that is too much for one task
        some = met.where(~(heavy & F.col("deep"))).select("lang", key.alias("key"), deep.alias("open"), F.when(heavy, F.ceil(F.col("total") / branch)).otherwise(1).alias("shares"), "sources", "trie")
        ready.append((some, lone))
        if weights.where(heavy & F.col("deep")).isEmpty():
            break
        depth += 1
        pieces = materialize(_deeper(met.where(heavy & F.col("deep")), depth))
        weights = materialize(pieces.groupBy(*by).agg(F.sum("n").alias("total")).withColumn("size", F.lit(depth)))

    def add_up(table: pa.Table) -> pa.Table:
        names, trie = _united(table)
        return pa.table({"lang": table.column("lang")[:1], "key": table.column("key")[:1], "open": table.column("open")[:1], "sources": pa.array([names], pa.list_(pa.string())), "trie": pa.array([trie.packed()], pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        names, trie = _united(table)
        trie = trie.kept(np.flatnonzero(trie.docs >= least_docs))
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, trie.sources, trie.counts)
        lists = [pa.array([names], pa.list_(pa.string())), pa.array([totals.tolist()], pa.list_(pa.int64()))]
        found = pa.table({"lang": table.column("lang")[:1], "sources": lists[0], "totals": lists[1], "n_terms": pa.array([len(trie)]), "trie": pa.array([trie.packed()], pa.binary())})
        return found.slice(0, 1 if len(trie) else 0)

    parts = []
    for some, lone in ready:
        if lone:
            shared = some.where("shares > 1").withColumn("share", F.pmod(F.xxhash64("trie"), F.col("shares")))
            parts.append(shared.groupBy("lang", "key", "open", "share").applyInArrow(add_up, "lang string, key binary, open boolean, sources array<string>, trie binary"))
            some = some.where("shares = 1")
        parts.append(some.drop("shares"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("lang", "key", "open").applyInArrow(keep, "lang string, sources array<string>, totals array<bigint>, n_terms bigint, trie binary")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 5) / total), exact: one decimal digit of the quotient after the other. total is N + 5 * V."""
    quotient, rest = np.divmod(count + ADDED, total)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 10, total)
        quotient = quotient * 10 + digit
    return quotient + 1


_TOLD = "lang string, source string, part string, item string, value bigint"


def _traversed(merged: DataFrame, top: int) -> DataFrame:
    """merged with names, ns and n_all_terms of the language: a row for each branch and pair of sources, and each source's strongest terms there."""

    def told(lang: str, names: list[str], source: np.ndarray, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array([lang] * n, pa.string()), pa.array(names, pa.string()).take(pa.array(source)), pa.array([part] * n, pa.string()), items, pa.array(values)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    def pairs(lang: str, names: list[str], trie: Trie, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(names), TILE):
            for j in range(i, len(names), TILE):
                left, right = totals[i : i + TILE], totals[j : j + TILE]
                sums = np.zeros((len(left), len(right)), np.int64)
                step = max(1, CELLS // len(names))
                for low in range(0, len(trie), step):
                    counts = trie.dense(low, min(low + step, len(trie)), len(names))
                    p, q = share(counts[:, i : i + TILE], left), share(counts[:, j : j + TILE], right)
                    for k in range(len(left)):
                        sums[k] += np.abs(p[:, k : k + 1] - q).sum(axis=0)
                a, b = np.nonzero(np.arange(i, i + len(left))[:, None] < np.arange(j, j + len(right))[None, :])
                if len(a):
                    yield told(lang, names, a + i, "pair", pa.array(names, pa.string()).take(pa.array(b + j)), sums[a, b])

    def strongest(lang: str, names: list[str], trie: Trie, totals: np.ndarray, whole: int) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(names)
        step = max(1, CELLS // len(names))
        for low in range(0, len(trie), step):
            counts = trie.dense(low, min(low + step, len(trie)), len(names))
            more = share(counts, totals) - share(counts.sum(axis=1, keepdims=True), np.array([whole]))
            more[counts == 0] = 0
            for g in np.flatnonzero((more > 0).any(axis=0)).tolist():
                at = np.flatnonzero(more[:, g] > 0)
                leaf, value = np.concatenate([best[g][0], at + low]), np.concatenate([best[g][1], more[at, g]])
                order = np.argsort(-value, kind="stable")[:top]  # leaves come in order, so a tie goes to the first
                order.sort()
                best[g] = leaf[order], value[order]
        source = np.repeat(np.arange(len(names)), [len(x) for x, _ in best])
        leaf, value = (np.concatenate(x) for x in zip(*best, strict=True))
        if len(leaf):
            items = pc.cast(trie.terms.take(pa.array(leaf)), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
            yield told(lang, names, source, "term", items, value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, ns, v = row["names"], np.array(row["ns"], np.int64), row["n_all_terms"]
                at = {s: i for i, s in enumerate(names)}
                trie = Trie.unpacked(row["trie"]).renumbered(np.array([at[s] for s in row["sources"]], np.int64))
                yield from pairs(row["lang"], names, trie, ns + ADDED * v)
                yield from strongest(row["lang"], names, trie, ns + ADDED * v, int(ns.sum()) + ADDED * v)

    return merged.mapInArrow(run, _TOLD)


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, branch: int = BRANCH, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value and rank: how each source of a language differs from the others, and by which terms.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. A language keeps the terms that least_docs
    of its rows of docs (text, lang, source) hold. A source's share of a term is 1 + floor(10 ** 9 * (count + 5) / (N + 5 V)),
    N its count of all V kept terms. Part pair: for each other source, the shares' differences summed over all kept terms.
    Part term: the first top terms that the source holds and has a greater share of than the language. Greatest value
    first, ties by the item's UTF-8 bytes, ranks from 1.

    Null text, lang or source count as ''. A source without kept terms still has its pairs (all 0 where the language keeps
    no term); repeated rows count as often as they stand; a very long text is counted as a whole, by one task; an empty
    table gives an empty one. Other columns are not looked at, whatever their names.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    merged = materialize(merged_tries(rows, least_docs, branch, held))
    sums = merged.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("s")).groupBy("lang", F.col("s.sources").alias("source")).agg(F.sum("s.totals").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    terms = merged.groupBy("lang").agg(F.sum("n_terms").alias("v"))
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"))  # the pairs of a language are its square
    langs = materialize(listed.join(terms, "lang", "left").select("lang", F.col("g.source").alias("names"), F.col("g.n").alias("ns"), F.coalesce("v", F.lit(0)).alias("n_all_terms")))
    found = materialize(_traversed(merged.join(langs, "lang"), top))
    one, two = F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))
    both = found.where("part = 'pair'").select("lang", "value", F.explode(F.array(one, two)).alias("x")).select("lang", "x.source", "x.item", "value")
    none = langs.select("lang", F.explode("names").alias("source"), "names").select("lang", "source", F.explode(F.filter("names", lambda s: s != F.col("source"))).alias("item"), F.lit(0).cast("bigint").alias("value"))
    pairs = both.unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    best = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.unionByName(best)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = rf"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tokens AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (SELECT lang, source, term, coalesce(n, 0) AS n, v, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS own, sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS n_all, sum(coalesce(n, 0)) OVER (PARTITION BY lang) AS whole
    FROM groups JOIN kept USING (lang) JOIN size USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (SELECT *, CAST(1 + (1000000000::HUGEINT * (n + {ADDED})) // (own + {ADDED} * v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (n_all + {ADDED})) // (whole + {ADDED} * v) AS BIGINT) AS q FROM grid),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
UNION ALL SELECT lang, source, 'term', item, value, CAST(rank AS INTEGER) FROM terms WHERE rank <= {TOP}"""
