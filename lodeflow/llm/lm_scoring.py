"""Language-model scoring from a log-frequency Bloom filter.

Counting deals the n-grams of all training texts to shards as packed, pre-added arrays. Each shard quantises its
word pairs' counts on a logarithmic scale, level = 1 + floor(log_b(count)), and inserts (pair, 1) to (pair,
level) into its piece of the filter. A count is read back by probing (pair, 1), (pair, 2), ... until a probe
fails. A probe touches one 64-bit word. Single words keep exact counts.

    p(w | v) = (C(v w) + k * p(w)) / (c(v) + k),   p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

k balances the two so that the mass which the model gives to pairs seen before equals the share of training
tokens whose pair occurs again in the training texts.

The filter and the vocabulary are broadcast only if together they stay within max_broadcast_bytes and a quarter of
the heap. Beyond that chunks of texts ask the shards, each distinct word and pair once a chunk; a shard makes the same probes, and its
answers go back to the chunk in the order of the asked keys, a byte or little more each. The results are the same.
A frequent word is asked for once a chunk too, so no shard holds the rows of its tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeflow.llm.ngram_jaccard import _bits, _unpack
from lodeflow.llm.words import _ORDER, U, Texts, Words, mix, release, running, signed, slices
from lodeflow.session import bound_batches, materialize

#: Base of the logarithmic count scale.
QUANTUM = 1.5
BITS_PER_ITEM = 10
MAX_LEVEL = 64
MAX_BROADCAST_BYTES = 512 << 20
COUNT_BYTES = 12 << 20
ASK_BYTES = 8 << 20  # of text in a chunk that asks the shards
_ASK_SLICE = 1 << 20
HEAD = 1 << 16  # of no effect any more, see score()
END = U(0x2545F4914F6CDD1D)
WORD, PAIR = 0, 1


def held_out_column(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def tokens_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by one end, and the bounds of each text's tokens."""
    words = Words.of(texts.lower())
    return np.insert(words.hashes, words.bounds[1:], END), words.bounds + np.arange(len(words.bounds))


def pairs_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context (the token before it, an end before a text's first) and the pair's hash."""
    before = np.append(END, tokens[:-1]) if len(tokens) else tokens
    return before, mix(before * _ORDER[2] + tokens * _ORDER[3])


def _place(key: np.ndarray, level: int, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the piece and the four bits in it that stand for (key, level)."""
    h = mix(key + U(level * 0xA24BAED4963EE407 % (1 << 64)))
    word = ((h >> U(32)) * np.asarray(width, U)) >> U(32)
    mask = U(1) << (h & U(63))
    for shift in (6, 12, 18):
        mask = mask | (U(1) << ((h >> U(shift)) & U(63)))
    return word, mask


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / np.log(QUANTUM) + 1e-9).astype(np.int64), MAX_LEVEL)


def count_at(level: np.ndarray) -> np.ndarray:
    """The middle of the counts on each level, 0 on level 0."""
    low = np.ceil(QUANTUM ** (np.maximum(level, 1) - 1.0) - 1e-6)
    high = np.ceil(QUANTUM ** np.maximum(level, 1).astype(float) - 1e-6) - 1
    return np.where(level > 0, (low + np.maximum(high, low)) / 2, 0.0)


def _piece(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    level = levels_of(counts)
    width = max(1, int(np.ceil(level.sum() * BITS_PER_ITEM / 64)))
    found = np.zeros(width, U)
    for j in range(1, int(level.max(initial=0)) + 1):
        word, mask = _place(keys[level >= j], j, width)
        order = np.argsort(word)
        word, mask = word[order], mask[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        found[word[first]] |= np.bitwise_or.reduceat(mask, first)
    return found


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def _counted(train: DataFrame, bits: int) -> DataFrame:
    """A row for each kind and shard: sorted words with counts, or a piece of the filter."""

    def pack(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            edge = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1).astype(U))
            used = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), kind, np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array([keys[edge[s] : edge[s + 1]].tobytes() for s in used], pa.binary()),
                    pa.array([counts[edge[s] : edge[s + 1]].astype(np.uint32).tobytes() for s in used], pa.binary()),
                ],
                names=["kind", "shard", "keys", "counts"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {WORD: [], PAIR: []}
        seen = 0
        for batch in slices(batches, "text"):
            texts = Texts.of(batch.column("text"))
            tokens, _ = tokens_of(texts)
            held[WORD].append(tokens)
            held[PAIR].append(pairs_of(tokens)[1])
            seen += len(texts.data)
            if seen >= COUNT_BYTES:
                yield from pack(held)
                held, seen = {WORD: [], PAIR: []}, 0
        if held[WORD]:
            yield from pack(held)

    def gather(table: pa.Table) -> pa.Table:
        release()
        kind = table.column("kind")[0].as_py()
        keys, counts = _summed(np.concatenate(_unpack(table, "keys", U)), np.concatenate(_unpack(table, "counts", np.uint32)).astype(np.int64))
        again = int(counts[counts > 1].sum())
        data, extra = (keys, counts) if kind == WORD else (_piece(keys, counts), np.zeros(0, np.int64))
        return pa.table(
            {
                "kind": pa.array([kind], pa.int32()),
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
                "data": pa.array([data.tobytes()]),
                "counts": pa.array([extra.tobytes()]),
                "n_keys": pa.array([len(keys)], pa.int64()),
                "n_tokens": pa.array([int(counts.sum())], pa.int64()),
                "n_again": pa.array([again], pa.int64()),
            }
        )

    dealt = train.select("text").mapInArrow(count, "kind int, shard int, keys binary, counts binary")
    return dealt.groupBy("kind", "shard").applyInArrow(gather, "kind int, shard int, data binary, counts binary, n_keys bigint, n_tokens bigint, n_again bigint")


def _balance(histogram: list[tuple[int, int]], again: int) -> float:
    """k from how many words have each count: sum of c * c / (c + k) over words is again, the tokens seen twice or more."""
    if not histogram:
        return 1.0
    c, n = np.array([h[0] for h in histogram], float), np.array([h[1] for h in histogram], float)
    low, high = -7.0, 16.0
    for _ in range(60):
        middle = (low + high) / 2
        if (n * c * c / (c + 10**middle)).sum() > again:
            low = middle
        else:
            high = middle
    return float(10**low)


@dataclass
class Model:
    """pieces: the written table of words and filter pieces; the rest are totals of the training texts."""

    pieces: DataFrame
    bits: int
    n_tokens: int
    n_words: int
    k: float
    n_bytes: int


def fit(train: DataFrame) -> Model:
    bound_batches(train.sparkSession)
    # a token is about six bytes, and each is counted by itself and with the one before it
    bits = _bits((train.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    pieces = materialize(_counted(train, bits), drop_shuffles=True)
    totals = {r.kind: r for r in pieces.groupBy("kind").agg(F.sum("n_keys").alias("keys"), F.sum("n_tokens").alias("tokens"), F.sum("n_again").alias("again"), F.sum(F.length("data") + F.length("counts")).alias("size")).collect()}

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                c, n = np.unique(np.frombuffer(x, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n.astype(np.int64))], names=["c", "n"])

    # one row for each different count of a word
    histogram = [(r.c, r.n) for r in pieces.where(f"kind = {WORD}").select("counts").mapInArrow(tally, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect()]
    word, pair = totals.get(WORD), totals.get(PAIR)
    return Model(pieces, bits, word.tokens if word else 0, word.keys if word else 0, _balance(sorted(histogram), pair.again if pair else 0), sum(r.size for r in totals.values()))


@dataclass
class Lookup:
    """The whole model as arrays, for broadcast."""

    words: np.ndarray
    counts: np.ndarray
    filter: np.ndarray
    first: np.ndarray
    width: np.ndarray
    bits: int

    @classmethod
    def of(cls, model: Model) -> Lookup:
        shards = 1 << model.bits
        size = {WORD: np.zeros(shards, np.int64), PAIR: np.zeros(shards, np.int64)}
        for r in model.pieces.select("kind", "shard", (F.length("data") / 8).cast("bigint").alias("n")).collect():
            size[r.kind][r.shard] = r.n
        at = {kind: running(n) for kind, n in size.items()}
        words, counts, bits = np.zeros(at[WORD][-1], U), np.zeros(at[WORD][-1], np.int64), np.zeros(at[PAIR][-1], U)
        for r in model.pieces.select("kind", "shard", "data", "counts").toLocalIterator():
            where = slice(at[r.kind][r.shard], at[r.kind][r.shard + 1])
            if r.kind == WORD:
                words[where], counts[where] = np.frombuffer(r.data, U), np.frombuffer(r.counts, np.int64)
            else:
                bits[where] = np.frombuffer(r.data, U)
        if counts.max(initial=0) < 1 << 32:
            counts = counts.astype(np.uint32)
        return cls(words, counts, bits, at[PAIR][:-1].astype(U), size[PAIR].astype(U), model.bits)

    def count(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at].astype(np.int64), 0)

    def level(self, pairs: np.ndarray) -> np.ndarray:
        """Probe levels upwards until the filter says no."""
        found = np.zeros(len(pairs), np.int64)
        shard = (pairs >> U(64 - self.bits)).astype(np.int64)
        alive = np.flatnonzero(self.width[shard] > 0)
        for j in range(1, MAX_LEVEL + 1):
            word, mask = _place(pairs[alive], j, self.width[shard[alive]])
            alive = alive[self.filter[self.first[shard[alive]] + word] & mask == mask]
            if not len(alive):
                break
            found[alive] = j
        return found


def log_probabilities(model: tuple[int, int, float], c_word: np.ndarray, c_before: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's base and model probability."""
    n_tokens, n_words, k = model
    base = (c_word + 0.5) / (n_tokens + 0.5 * (n_words + 1))
    seen = np.minimum(np.minimum(count_at(level), c_word), c_before)
    return np.log10(base), np.log10((seen + k * base) / (c_before + k))


SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def broadcast_room(spark: SparkSession) -> int:
    """A quarter of the smaller heap of driver and executors: beside it, the driver's Python and each Python worker hold the model once more."""
    context = spark.sparkContext
    conf, heaps = context._jsc.sc().conf(), ["driver"] if context.master.split("[")[0] == "local" else ["driver", "executor"]
    return min(conf.getSizeAsBytes(f"spark.{heap}.memory", "1g") for heap in heaps) // 4


def _scored(batch: pa.RecordBatch, bounds: np.ndarray, totals: tuple[int, int, float], train_tokens: int, c_word: np.ndarray, n_end: int, level: np.ndarray) -> pa.RecordBatch:
    """The rows of some texts from their tokens' counts, the count of the end, and their pairs' levels."""
    c_before = np.append(n_end, c_word[:-1])
    base, own = log_probabilities(totals, c_word, c_before, level)
    add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  a text has one token at least
    n = np.diff(bounds).astype(np.int64)
    columns = [n, add((c_word > 0).astype(np.int64)), np.full(len(n), train_tokens), add(base), add(own)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *map(pa.array, columns)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, model: Model, max_broadcast_bytes: int = MAX_BROADCAST_BYTES, head: int = HEAD) -> DataFrame:
    """A row for each row of docs (doc_id, text, held_out).

    A null or empty text is its one end token. Unknown words get the base model's share of an unseen word.
    Repeated rows and ids each get their row; no training text at all leaves the uniform base model; an empty
    table gives an empty one; other columns are not read. A very long text is scored whole, as a slice of its own.
    head says nothing any more: beyond the broadcast no key is asked for more than once a chunk.
    """
    if model.n_bytes > min(max_broadcast_bytes, broadcast_room(docs.sparkSession)):
        return _score_by_shards(docs, model)
    bound_batches(docs.sparkSession)
    lookup = docs.sparkSession.sparkContext.broadcast(Lookup.of(model))
    totals, train_tokens = (model.n_tokens, model.n_words, model.k), model.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier tasks of this worker have left
        table = lookup.value
        for batch in slices(batches, "text", 1 << 20):
            tokens, bounds = tokens_of(Texts.of(batch.column("text")))
            distinct, back = np.unique(tokens, return_inverse=True)
            c_word = table.count(distinct)[back]
            _, pairs = pairs_of(tokens)
            n_end = int(table.count(np.array([END], U))[0])
            yield _scored(batch, bounds, totals, train_tokens, c_word, n_end, table.level(pairs))

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCHEMA)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes each as the largest needs, after one byte that says how many."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    held = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    values = np.zeros((len(held), 8), np.uint8)
    values[:, : data[0]] = held
    return values.view("<u8").ravel().astype(U, copy=False)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted; numpy's own unique builds a hash table here, which is slower and larger."""
    keys = np.concatenate(parts)
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])]


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and the pairs of some texts."""
    tokens, _ = tokens_of(Texts.of(batch.column("text")))
    return _distinct([tokens]), pairs_of(tokens)[1]


def _score_by_shards(docs: DataFrame, model: Model) -> DataFrame:
    """The same scores with the vocabulary and the filter left distributed."""
    bits = model.bits
    shift, n_shards = U(64 - bits), 1 << bits
    totals, train_tokens = (model.n_tokens, model.n_words, model.k), model.n_tokens
    bound_batches(docs.sparkSession)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, seen = TaskContext.get().partitionId() << 32, 0, 0
        for batch in slices(batches, "text", _ASK_SLICE):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(place, place + n)), *batch.columns], names=["chunk", "place", *batch.schema.names])
            place += n
            seen += 16 * n + (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
            if seen >= ASK_BYTES:
                number, place, seen = number + 1, 0, 0

    def dealt(keys: np.ndarray) -> pa.Array:
        """By shard: the steps from each key to the next."""
        edge = np.searchsorted(keys >> shift, np.arange(n_shards + 1).astype(U))
        return pa.array([_packed(np.diff(keys[edge[s] : edge[s + 1]], prepend=U(s) << shift)) for s in range(n_shards)], pa.binary())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's rows may be read in several runs; each run, known by its first place, asks by itself."""
        release()  # what earlier tasks of this worker have left
        held: list[tuple[np.ndarray, np.ndarray]] = []
        number = first = following = -1

        def asked() -> Iterator[pa.RecordBatch]:
            words, pairs = (dealt(_distinct(list(keys))) for keys in zip(*held, strict=True))
            rows = pa.table([pa.array(np.full(n_shards, number)), pa.array(np.full(n_shards, first)), pa.array(np.arange(n_shards, dtype=np.int32)), words, pairs], ["chunk", "first", "shard", "words", "pairs"])
            yield from rows.filter(pc.greater(pc.add(pc.binary_length(words), pc.binary_length(pairs)), 2)).to_batches(max_chunksize=256)

        for batch in slices(batches, "text", _ASK_SLICE):
            chunks, places = (batch.column(c).to_numpy() for c in ("chunk", "place"))
            edge = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(places) != 1)) + 1), len(chunks)]
            for low, high in zip(edge, edge[1:], strict=False):
                if (chunks[low], places[low]) != (number, following):
                    if held:
                        yield from asked()
                    held, number, first = [], int(chunks[low]), int(places[low])
                held.append(_keys(batch.slice(low, high - low)))
                following = int(places[high - 1]) + 1
        if held:
            yield from asked()

    def answer(key: tuple[pa.Scalar, ...], pieces: pa.Table, asks: pa.Table) -> pa.Table:
        release()
        shard = key[0].as_py()
        said = {k: (d, c) for k, d, c in zip(*(pieces.column(x).to_pylist() for x in ("kind", "data", "counts")), strict=True)}
        (words, counts), (bits_of, _) = (said.get(k, (b"", b"")) for k in (WORD, PAIR))
        width = np.zeros(n_shards, U)
        width[shard] = len(bits_of) // 8
        table = Lookup(np.frombuffer(words, U), np.frombuffer(counts, np.int64), np.frombuffer(bits_of, U), np.zeros(n_shards, U), width, bits)

        def answers(name: str, look: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
            """Of all rows at once, as each has few keys."""
            keys = [(U(shard) << shift) + np.cumsum(_unpacked(x), dtype=U) for x in asks.column(name).to_pylist()]
            edge = running(np.array([len(x) for x in keys], np.int64))
            found = look(np.concatenate([*keys, np.zeros(0, U)]))
            return pa.array([_packed(found[low:high]) for low, high in zip(edge, edge[1:], strict=False)], pa.binary())

        return asks.select(["chunk", "first", "shard"]).append_column("counts", answers("words", table.count)).append_column("levels", answers("pairs", table.level))

    def meet(rows: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        rows, answers = rows.sort_by("place"), answers.sort_by([("first", "ascending"), ("shard", "ascending")])
        firsts, begin = np.unique(answers.column("first").to_numpy(), return_index=True)
        edge, end = np.append(np.searchsorted(rows.column("place").to_numpy(), firsts), len(rows)), np.append(begin, len(answers))
        found = []
        for i in range(len(firsts)):
            told = answers.slice(end[i], end[i + 1] - end[i])
            counts, levels = (np.concatenate([_unpacked(x).astype(kind) for x in told.column(name).to_pylist()]) for name, kind in (("counts", np.int64), ("levels", np.int8)))
            parts = list(slices(iter(rows.slice(edge[i], edge[i + 1] - edge[i]).to_batches()), "text", _ASK_SLICE))
            words, pairs = (_distinct(list(keys)) for keys in zip(*map(_keys, parts), strict=True))
            n_end = int(counts[np.searchsorted(words, END)])
            for batch in parts:
                tokens, bounds = tokens_of(Texts.of(batch.column("text")))
                c_word, level = counts[np.searchsorted(words, tokens)], levels[np.searchsorted(pairs, pairs_of(tokens)[1])]
                found.append(_scored(batch, bounds, totals, train_tokens, c_word, n_end, level.astype(np.int64)))
        return pa.Table.from_batches(found)

    rows = materialize(docs.select(F.col("doc_id").cast("bigint"), "held_out", "text").mapInArrow(chunk, "chunk bigint, place bigint, doc_id bigint, held_out boolean, text string"))
    asks = rows.mapInArrow(ask, "chunk bigint, first bigint, shard int, words binary, pairs binary")
    pieces = model.pieces.select("kind", "shard", "data", "counts")
    answers = materialize(pieces.groupBy("shard").cogroup(asks.groupBy("shard")).applyInArrow(answer, "chunk bigint, first bigint, shard int, counts binary, levels binary"), drop_shuffles=True)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, SCHEMA)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out_column().alias("held_out"))
    return score(docs, fit(docs.where("NOT held_out")))
