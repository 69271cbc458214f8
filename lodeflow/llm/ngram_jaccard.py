"""Exact Jaccard join of documents' word n-gram sets, without comparing all pairs.

1. Every document becomes the set of its hashed n-grams. Equal sets share one signature and stay one member.
2. Chunks of documents deal 32-bit prints of their n-grams to shards, which tell each chunk how many n-grams of a
   set others may have too. Two sets that link share an n-gram within the prefixes of both, in any order; with the
   n-grams that no other set has first, most sets have no common one within their prefix and end here.
3. Only the sets that are left are dealt again, with whole n-grams. Packed shards give each n-gram's number of
   sets, by which a set's n-grams are ordered from rare to frequent; n-grams of very many sets need no count: they
   are dealt by set and come last. The inverted index holds the prefixes in this order.
4. Each index list links its members with its most central one (the star), and what is linked needs no further
   comparison: members of one component skip each other.
5. The rest of a list is split into blocks by size and position. Pairs of blocks that sizes or positions rule
   out, or that hold one component only, are skipped whole.
6. For a pair that is left, the answer of the highly similar centre of one side is computed first and decides
   for most of its members: |x & y| <= |c & y| + |x| - |x & c|. Only what this leaves open is counted itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm.words import U, Texts, Words, mix, release, running, signed, slices, window_starts, windows
from lodeflow.operators.components import connected_components
from lodeflow.session import bound_batches, materialize

SHINGLE_WORDS = 4
PERCENT = 85
#: Text, and rows at most, gathered to a chunk before its n-grams are dealt to the shards.
DEAL_BYTES, DEAL_ROWS = 8 << 20, 1 << 16
#: N-grams of a shard, about: what one task sorts at once.
SHARD_GRAMS = 2_000_000
#: Share of a chunk's n-grams from which one may be frequent (so at most the inverse of it are), and in how many sets it is then at least.
FREQUENT_SHARE, FREQUENT_SETS = 1e-5, 1000
#: The filter that finds the texts of the sets that are left: bits for each of them, and bytes at most. A fuller filter lets
#: more texts through, which costs time and changes nothing.
FILTER_BITS, FILTER_BYTES = 16, 16 << 20
#: Bytes of text for each n-gram, about.
PRINT_BYTES = 8
_PIECE_WORDS = 1 << 14  # 32-bit words of a filter's pieces, each put together by one task
_MANY = 0xFFFFFFFF


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text one after the other, and the bounds of each text's set.

    A text with fewer words than size has all its words as its one n-gram; one without words has an empty set.
    """
    words = Words.of(texts.lower())
    starts, _ = window_starts(words.bounds, size)
    grams = windows(words.hashes, size)[starts] if len(starts) else np.zeros(0, U)
    at = running(np.maximum(words.counts - size + 1, 0))
    sets = []
    for i, n in enumerate(words.counts.tolist()):
        if n >= size:
            sets.append(np.unique(grams[at[i] : at[i + 1]]))
        elif n:
            sets.append(windows(words.hashes[words.bounds[i] : words.bounds[i + 1]], n) + U(n))
        else:
            sets.append(np.zeros(0, U))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), running(np.array([len(s) for s in sets], np.int64))


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set as a whole."""
    sums = np.zeros(len(grams) + 1, U)
    np.cumsum(mix(grams ^ U(0x5851F42D4C957F2D)), out=sums[1:])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ np.diff(bounds).astype(U))


def _bits(n_grams: int) -> int:
    """Bits that name a shard: 64 shards at least, more for more n-grams, so that one holds a bounded number of them."""
    return max(6, int(np.ceil(np.log2(max(n_grams, 1) / SHARD_GRAMS))))


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of about DEAL_BYTES of text and DEAL_ROWS rows at most, whatever Arrow batches hold, with their sets: n-grams, n-grams of each row, signatures."""
    release()  # what earlier tasks of this worker have left
    held: list[tuple] = []
    seen = rows = 0

    def whole() -> tuple:
        batches, grams, counts, sigs = zip(*held, strict=True)
        return list(batches), np.concatenate(grams), np.concatenate(counts), np.concatenate(sigs)

    for batch in (b.slice(at, DEAL_ROWS) for b in slices(batches, "text") for at in range(0, b.num_rows, DEAL_ROWS)):
        if held and rows + batch.num_rows > DEAL_ROWS:  # a set's place in its chunk is 16 bits wide
            yield whole()
            held, seen, rows = [], 0, 0
        texts = Texts.of(batch.column("text"))
        grams, bounds = shingle_sets(texts, size)
        held.append((batch.drop_columns(["text"]), grams, np.diff(bounds), signatures(grams, bounds)))
        seen, rows = seen + len(texts.data), rows + batch.num_rows
        if seen >= DEAL_BYTES:
            yield whole()
            held, seen, rows = [], 0, 0
    if held:
        yield whole()
    held.clear()
    release()


def _fresh(sig: np.ndarray) -> np.ndarray:
    """True at the first row of each signature."""
    found = np.zeros(len(sig), bool)
    found[np.unique(sig, return_index=True)[1]] = True
    return found


_CHUNK = "doc_id array<bigint>, key array<bigint>, n array<bigint>, sig array<bigint>, place array<bigint>, near array<bigint>, frequent binary"


def _prints(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Prints of every chunk's n-grams by shard, and a row for the chunk itself that any shard hands on.

    single: prints of n-grams that one set of the chunk has, owner: that set's place; several: those of more sets,
    which are known to be shared and are counted in near already. An n-gram leaves a chunk once at most, so no
    shard grows with one n-gram.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for number, (held, grams, counts, sig) in enumerate(_chunks(batches, size)):
            fresh = _fresh(sig)
            _, place = np.unique(sig, return_inverse=True)
            use = np.repeat(fresh, counts)
            grams, owner = grams[use], np.repeat(place, counts)[use]
            order = np.argsort(grams)
            grams, owner = grams[order], owner[order]
            edge = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
            many = np.diff(np.append(edge, len(grams)))
            lone = np.repeat(many == 1, many)
            near = np.bincount(owner[~lone], minlength=len(sig))
            often = (many > 1) & (many >= FREQUENT_SHARE * len(grams))
            frequent = np.stack([grams[edge[often]], many[often].astype(U)], axis=1).tobytes()
            shard, low = grams >> U(64 - bits), ((grams << U(bits)) >> U(32)).astype(np.uint32)
            first = edge[many > 1]
            cuts = [np.searchsorted(x, np.arange((1 << bits) + 1)) for x in (shard[lone], shard[first])]
            singles, owners, several = low[lone], owner[lone].astype(np.uint16), low[first]
            filled = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0)).tolist()
            kinds = [pa.int64()] * 2 + [pa.binary()] * 3
            for at in range(0, len(filled), 256):
                some = filled[at : at + 256]
                columns = [
                    some,
                    [part | number] * len(some),
                    [singles[cuts[0][s] : cuts[0][s + 1]].tobytes() for s in some],
                    [owners[cuts[0][s] : cuts[0][s + 1]].tobytes() for s in some],
                    [several[cuts[1][s] : cuts[1][s + 1]].tobytes() for s in some],
                ]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                none = [pa.nulls(len(some), pa.list_(pa.int64()))] * 6 + [pa.nulls(len(some), pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *none], names=names)
            own = [pa.array([number % (1 << bits)]), pa.array([part | number]), *([pa.nulls(1, pa.binary())] * 3)]
            lists = [*(pa.concat_arrays([b.column(x).cast(pa.int64()) for b in held]) for x in ("doc_id", "key")), *map(pa.array, (counts, signed(sig), place, near))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(pa.int64())) for x in lists]
            yield pa.RecordBatch.from_arrays([*own, *lists, pa.array([frequent], pa.binary())], names=names)

    names = ["shard", "chunk", "single", "owner", "several", "doc_id", "key", "n", "sig", "place", "near", "frequent"]
    return docs.mapInArrow(deal, f"shard bigint, chunk bigint, single binary, owner binary, several binary, {_CHUNK}")


def _answers(prints: DataFrame) -> DataFrame:
    """For each shard and chunk: the places of the sets whose prints another set may have, once for each such print."""

    def answer(table: pa.Table) -> pa.Table:
        release()
        asks = table.filter(table.column("single").is_valid())
        single, several = _unpack(asks, "single", np.uint32), _unpack(asks, "several", np.uint32)
        owner = _unpack(asks, "owner", np.uint16)
        every = np.sort(np.concatenate([*single, *several, *several, np.zeros(0, np.uint32)]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        shared = [x[twice[np.minimum(np.searchsorted(twice, p), len(twice) - 1)] == p].tobytes() if len(twice) else b"" for p, x in zip(single, owner, strict=True)]
        said = pa.table({"chunk": asks.column("chunk"), "owner": pa.array(shared, pa.binary())})
        told = table.filter(table.column("single").is_null()).drop_columns(["shard", "single", "several"])
        return pa.concat_tables([told, said.filter(pc.greater(pc.binary_length(said.column("owner")), 0))], promote_options="default").select(names)

    names = ["chunk", "owner", "doc_id", "key", "n", "sig", "place", "near", "frequent"]
    return prints.groupBy("shard").applyInArrow(answer, f"chunk bigint, owner binary, {_CHUNK}")


def _met(answers: DataFrame, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, sig of each row, and open: whether the set may link; frequent in a further row for each chunk."""

    def close(table: pa.Table) -> pa.Table:
        own = table.filter(table.column("sig").is_valid())
        doc_id, key, n, sig, place, near = (own.column(x).combine_chunks().flatten() for x in ("doc_id", "key", "n", "sig", "place", "near"))
        n, place, shared = n.to_numpy(), place.to_numpy(), near.to_numpy().copy()
        for x in table.column("owner").drop_null().to_pylist():
            shared += np.bincount(np.frombuffer(x, np.uint16), minlength=len(shared))
        lone = n - shared[place]
        may = (n > 0) & (lone < n - (percent * n + 99) // 100 + 1)
        rows = pa.table({"doc_id": doc_id, "key": key, "n_shingles": pa.array(n), "sig": sig, "open": pa.array(may), "frequent": pa.nulls(len(n), pa.binary())})
        none = {k: pa.nulls(1, rows.schema.field(k).type) for k in ("doc_id", "key", "n_shingles", "sig", "open")}
        return pa.concat_tables([rows, pa.table({**none, "frequent": own.column("frequent").combine_chunks()})])

    return answers.groupBy("chunk").applyInArrow(close, "doc_id bigint, key bigint, n_shingles bigint, sig bigint, open boolean, frequent binary")


def row_key() -> Column:
    """Tells rows apart by their id and text."""
    return F.xxhash64("doc_id", "text")


def _probes(n_bits: int) -> Column:
    """The three bits of a filter that key has."""
    return F.array(*(F.pmod(F.xxhash64("key", F.lit(i)), F.lit(n_bits)) for i in range(3)))


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n keys, FILTER_BYTES at most, as 32-bit words: no key is missing from it."""
    n_words = max(1, min(FILTER_BYTES // 4, n * FILTER_BITS // 32))

    def pack(table: pa.Table) -> pa.Table:
        piece = table.column("piece")[0].as_py()
        words = np.zeros(min(_PIECE_WORDS, n_words - piece * _PIECE_WORDS), np.uint32)
        words[table.column("word").to_numpy() - piece * _PIECE_WORDS] = table.column("bits").to_numpy()
        return pa.table({"piece": [piece], "part": pa.array([words.tobytes()])})

    bits = keys.select(F.explode(_probes(32 * n_words)).alias("bit")).select(F.shiftright("bit", 5).alias("word"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).withColumn("piece", F.expr(f"word div {_PIECE_WORDS}"))
    found = np.zeros(n_words, np.uint32)
    for row in words.groupBy("piece").applyInArrow(pack, "piece bigint, part binary").collect():
        part = np.frombuffer(row.part, np.uint32)
        found[row.piece * _PIECE_WORDS : row.piece * _PIECE_WORDS + len(part)] = part
    return found


def _frequent(met: DataFrame, n_grams: int, least: int) -> np.ndarray:
    """The n-grams in very many sets, in order: 1 / FREQUENT_SHARE of them at most."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("frequent").to_pylist():
                pairs = np.frombuffer(x, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["gram", "sets"])

    found = met.where("frequent IS NOT NULL").select("frequent").mapInArrow(unpack, "gram bigint, sets bigint")
    found = found.groupBy("gram").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= max(least, FREQUENT_SHARE * n_grams))
    return np.sort(np.array([r.gram for r in found.select("gram").collect()], np.int64).view(U))


def _among(grams: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(grams), bool)
    return frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams


def _deal(docs: DataFrame, size: int, bits: int, frequent: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """Every n-gram of every distinct set of a chunk of the wanted texts, packed by the n-gram's shard; frequent ones by their set's."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("probes").flatten().to_numpy().reshape(-1, 3)
            yield batch.filter(pa.array(((wanted[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1).all(axis=1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams, count, sig in _chunks(pick(batches), size):
            fresh = _fresh(sig)
            owner = np.repeat(np.arange(len(sig)), count)
            grams, owner = grams[fresh[owner]], owner[fresh[owner]]
            by = np.where(_among(grams, frequent), sig[owner], grams)
            shard = (by >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(shard, kind="stable")
            grams, owner, shard = grams[order], owner[order], shard[order]
            for a, b in _runs(shard):
                who, many = np.unique(owner[a:b], return_counts=True)  # in order, as the n-grams are
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(shard[a])], pa.int32()),
                        pa.array([grams[a:b].tobytes()]),
                        pa.array([many.astype(np.uint32).tobytes()]),
                        pa.array([sig[who].tobytes()]),
                        pa.array([count[who].astype(np.uint32).tobytes()]),
                    ],
                    names=["shard", "grams", "many", "sigs", "sizes"],
                )

    return docs.select(_probes(32 * len(wanted)).alias("probes"), "text").mapInArrow(deal, "shard int, grams binary, many binary, sigs binary, sizes binary")


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs of equal neighbours."""
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    yield from zip([0, *edge], [*edge, len(key)], strict=True) if len(key) else ()


def _unpack(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _shared(dealt: DataFrame, bits: int, frequent: np.ndarray) -> DataFrame:
    """For each shard of sets: their n-grams that other sets have too, and how many sets have each (_MANY if it is frequent)."""

    def count(table: pa.Table) -> pa.Table:
        release()
        sigs, sizes, many, grams = (np.concatenate(_unpack(table, k, t)) for k, t in (("sigs", U), ("sizes", np.uint32), ("many", np.uint32), ("grams", U)))
        at = np.repeat(np.arange(len(sigs)), many)
        order = np.argsort(grams)
        ordered = grams[order]
        same = ordered[1:] == ordered[:-1]
        order = order[np.append(same, False) | np.append(False, same) | _among(ordered, frequent)] if len(ordered) else order
        grams, at = grams[order], at[order]
        order = np.lexsort((sigs[at], grams))
        grams, at = grams[order], at[order]
        if len(grams):
            once = np.append(True, (grams[1:] != grams[:-1]) | (sigs[at][1:] != sigs[at][:-1]))
            grams, at = grams[once], at[once]
            _, back, df = np.unique(grams, return_inverse=True, return_counts=True)
            df = np.where(_among(grams, frequent), _MANY, df[back])
            grams, at, df = grams[df > 1], at[df > 1], df[df > 1]
        else:
            df = np.zeros(0, np.int64)
        order = np.argsort(sigs[at], kind="stable")
        grams, at, df = grams[order], at[order], df[order]
        sig = sigs[at]
        shard = (sig >> U(64 - bits)).astype(np.int64)
        rows: dict[str, list] = {"shard": [], "sigs": [], "sizes": [], "counts": [], "grams": [], "df": []}
        for a, b in _runs(shard):
            who, first, many = np.unique(sig[a:b], return_index=True, return_counts=True)
            for name, x in (("sigs", who), ("sizes", sizes[at[a:b][first]]), ("counts", many.astype(np.uint32)), ("grams", grams[a:b]), ("df", df[a:b].astype(np.uint32))):
                rows[name].append(x.tobytes())
            rows["shard"].append(int(shard[a]))
        return pa.table({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in rows.items()})

    return dealt.groupBy("shard").applyInArrow(count, "shard int, sigs binary, sizes binary, counts binary, grams binary, df binary")


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Sets whose prefix reaches beyond their lone n-grams: sig, n, lone, and the shared n-grams from rare to frequent."""

    def order_sets(table: pa.Table) -> pa.Table:
        sig = np.concatenate([np.repeat(s, c) for s, c in zip(_unpack(table, "sigs", U), _unpack(table, "counts", np.uint32), strict=True)])
        size = np.concatenate([np.repeat(s, c) for s, c in zip(_unpack(table, "sizes", np.uint32), _unpack(table, "counts", np.uint32), strict=True)]).astype(np.int64)
        grams, df = np.concatenate(_unpack(table, "grams", U)), np.concatenate(_unpack(table, "df", np.uint32))
        order = np.argsort(sig, kind="stable")
        edge = np.flatnonzero(np.append(True, sig[order][1:] != sig[order][:-1])) if len(sig) else np.zeros(0, np.int64)
        many = np.diff(np.append(edge, len(sig)))
        who, n = sig[order][edge], size[order][edge]
        reach = n - (percent * n + 99) // 100 + 1
        keep = np.repeat(n - many < reach, many)
        order = order[keep]
        picked = n - many < reach
        many, who, n = many[picked], who[picked], n[picked]
        owner = np.repeat(np.arange(len(who)), many)
        order = order[np.lexsort((grams[order], df[order], owner))]
        lists = pa.LargeListArray.from_arrays(pa.array(running(many)), pa.array(signed(grams[order]))).cast(pa.list_(pa.int64()))
        return pa.table({"sig": pa.array(signed(who)), "n": pa.array(n), "lone": pa.array(n - many), "grams": lists})

    return shared.groupBy("shard").applyInArrow(order_sets, "sig bigint, n bigint, lone bigint, grams array<bigint>")


def _may_link(percent: int, a: str, b: str, n: tuple[str, str] = ("n", "n"), pos: str = "pos", top: str = "n") -> Column:
    """Whether sizes and positions (of the first common n-gram, from 0) leave room for a link of a and b."""
    both = F.least(F.col(f"{a}.{top}") - F.col(f"{a}.{pos}"), F.col(f"{b}.{top}") - F.col(f"{b}.{pos}"))
    low, high = n
    return (
        ((100 + percent) * both >= percent * (F.col(f"{a}.{low}") + F.col(f"{b}.{low}")))
        & (100 * F.col(f"{a}.{high}") >= percent * F.col(f"{b}.{low}"))
        & (100 * F.col(f"{b}.{high}") >= percent * F.col(f"{a}.{low}"))
    )


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (x, y) with nx, ny, common and linked, counted exactly."""
    one = sets.select(F.col("sig").alias("x"), F.col("n").alias("nx"), F.col("grams").alias("gx"))
    two = sets.select(F.col("sig").alias("y"), F.col("n").alias("ny"), F.col("grams").alias("gy"))
    met = pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", F.size(F.array_intersect("gx", "gy")).cast("bigint").alias("common"))
    return met.withColumn("linked", 100 * F.col("common") >= percent * (F.col("nx") + F.col("ny") - F.col("common")))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of sets that link; enough of them to connect all that do."""
    reach = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - lone").cast("int")
    index = sets.select("sig", "n", "lone", F.posexplode(F.slice("grams", F.lit(1), reach)).alias("place", "gram"))
    index = index.select("gram", "sig", "n", (F.col("lone") + F.col("place")).alias("pos"))

    # the star: each list's member with the fewest rarer n-grams stands for the list
    centre = index.groupBy("gram").agg(F.min(F.struct("pos", "sig", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    star = index.alias("m").join(centre.select("gram", "c.*").alias("c"), "gram").where((F.col("m.sig") != F.col("c.sig")) & _may_link(percent, "m", "c"))
    star = star.select(F.col("m.sig").alias("x"), F.col("c.sig").alias("y")).distinct()
    star = materialize(_overlaps(star, sets, percent).where("linked"))
    known = materialize(connected_components(star, "x", "y"))

    # block skipping
    block = F.struct(F.floor(F.log("n") / max(0.01, float(np.log(100 / percent)))).alias("size"), F.shiftright("pos", 3).alias("place"))
    entry = index.join(known.withColumnRenamed("node", "sig"), "sig", "left").select("gram", "sig", "n", "pos", F.coalesce("component", "sig").alias("component"), block.alias("block"))
    lists = entry.groupBy("gram", "block").agg(
        F.min("pos").alias("pos"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    wide = lists.groupBy("gram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("gram")
    lists = lists.join(wide, "gram", "left_semi")
    blocks = lists.alias("a").join(lists.alias("b"), "gram").where(
        (F.col("a.block") <= F.col("b.block"))
        & ((F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high")) | (F.col("a.low") != F.col("b.low")))
        & _may_link(percent, "a", "b", ("least", "most"), top="most")
    )
    blocks = blocks.select("gram", F.col("a.block").alias("block"), F.col("b.block").alias("other"))
    left = blocks.join(entry, ["gram", "block"]).select("gram", F.col("other").alias("block"), F.col("block").alias("own"), "sig", "n", "pos", "component")
    open_pairs = left.alias("a").join(entry.alias("b"), ["gram", "block"]).where(
        (F.col("a.component") != F.col("b.component")) & ((F.col("a.own") != F.col("block")) | (F.col("a.sig") < F.col("b.sig"))) & _may_link(percent, "a", "b")
    )
    open_pairs = materialize(open_pairs.select(F.least("a.sig", "b.sig").alias("x"), F.greatest("a.sig", "b.sig").alias("y")).distinct())

    # what a highly similar centre's answer says about its members
    near = star.select("x", F.col("y").alias("c"), (F.col("nx") - F.col("common")).alias("apart"), "common").groupBy("x").agg(F.min(F.struct("apart", "c")).alias("near")).select("x", "near.apart", "near.c")
    asked = open_pairs.join(near, "x", "left").select("x", "y", "c", F.coalesce("apart", F.lit(0)).alias("apart"))
    first = asked.select(F.coalesce("c", "x").alias("x"), "y").where("x <> y").distinct()
    first = materialize(_overlaps(first, sets, percent))
    later = asked.where("c IS NOT NULL").join(first.select(F.col("x").alias("c"), "y", F.col("common").alias("bound"), "ny", F.col("linked").alias("joined")), ["c", "y"], "left")
    later = later.join(sets.select(F.col("sig").alias("x"), F.col("n").alias("nx")), "x")
    most = F.col("bound") + F.col("apart")
    later = later.where(F.col("bound").isNull() | (~F.col("joined") & ((100 + percent) * most >= percent * (F.col("nx") + F.col("ny")))))
    second = _overlaps(later.select("x", "y"), sets, percent)

    links = star.select("x", "y").unionByName(first.where("linked").select("x", "y")).unionByName(second.where("linked").select("x", "y"))
    return links


def jaccard_rows(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, frequent_sets: int = FREQUENT_SETS) -> DataFrame:
    """doc_id, n_shingles, key, component and component_id for each row of docs (see jaccard_components).

    key is row_key() of the row; component names the group of linked sets, also where ids are null or repeat, and is
    null for an empty set.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", row_key().alias("key"), "text")
    most = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    met = materialize(_met(_answers(_prints(docs, size, _bits(most // PRINT_BYTES))), percent))
    rows = met.where("n_shingles IS NOT NULL").drop("frequent")
    # one text for each set that may link: that of its smallest key
    left = materialize(rows.where("open").groupBy("sig").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n")))
    n_sets, n_grams = left.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits, frequent = _bits(n_grams), _frequent(met, n_grams, frequent_sets)
    dealt = _deal(docs, size, bits, frequent, _filter(left, n_sets))
    sets = materialize(_candidates(_shared(dealt, bits, frequent), percent))
    links = _links(sets, percent)
    groups = materialize(connected_components(links, "x", "y").withColumnRenamed("node", "sig"))
    least = materialize(rows.where("n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("least")))
    linked = least.join(groups, "sig")
    roots = materialize(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    linked = linked.select("sig", "component").join(roots, "component")
    named = least.join(linked, "sig", "left").select("sig", F.coalesce("component", "sig").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    held = rows.where("n_shingles > 0").join(materialize(named), "sig").select("doc_id", "n_shingles", "key", "component", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", "key", F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("component_id"))
    return held.unionByName(empty)


def jaccard_components(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, frequent_sets: int = FREQUENT_SETS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for each row of docs.

    Two documents link when 100 * |a & b| >= percent * |a | b|. Null and empty texts have empty sets, link with
    nothing and are their own component. Rows with equal texts link, repeated ids included. A row with a null id
    carries links on, and its component_id is the smallest id reached, null if there is none. A very long text is
    hashed in segments and its set is held whole, eight bytes for each distinct n-gram. Other columns are not
    read, and an empty table gives an empty one.
    """
    return jaccard_rows(docs, size, percent, frequent_sets).select("doc_id", "n_shingles", "component_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs, so for small tables only.
OP3_SQL = r"""
WITH RECURSIVE split AS (
    SELECT row_number() OVER () AS r, doc_id,
           list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
    FROM split
), sized AS (SELECT r, doc_id, CAST(len(s) AS BIGINT) AS n FROM sets), grams AS (SELECT r, unnest(s) AS g FROM sets),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sized x ON x.r = a JOIN sized y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, t) AS (SELECT r, r FROM sized UNION SELECT reach.r, sides.b FROM reach JOIN sides ON reach.t = sides.a),
least AS (SELECT reach.r, min(sized.doc_id) AS component_id FROM reach JOIN sized ON sized.r = reach.t GROUP BY reach.r)
SELECT doc_id, n AS n_shingles, component_id FROM sized JOIN least USING (r)
"""
