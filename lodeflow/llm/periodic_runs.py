"""Runs of words that repeat with a period, found on a harmonic grid.

Words are the stretches of bytes outside the six ASCII white space characters. A run is a stretch of consecutive words
with smallest period q (words q apart are the same), as long as max(6, 4 * q) at least, that no neighbouring word
extends with the same period.

1. Words of a slice of texts get exact numbers (one for each distinct word), and prefix hashes over these.
2. For each period p, grid points stand 3 * p apart: a run of period p holds 4 * p words, so it holds such a point
   and the word p behind it. A text of n words has about n / 3 * ln(n) pairs (period, grid point) in all.
3. The words before and behind a point that are the same p words on (the longest common extensions) are found by a
   binary search over the hashes, for all pairs at once. A hash can only find them too long, never too short.
4. The same stretch is kept once, with its smallest period, and its words are compared themselves. Where they differ
   (the hashes lied) the extensions of that text and period are found anew by comparing words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.words import U, Texts, mix, release, running, slices
from lodeflow.session import bound_batches

#: A run is so long at least, in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Pairs of period and grid point, or words, worked on at once.
BLOCK = 1 << 20
_STEP = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_numbers(texts: Texts) -> tuple[np.ndarray, np.ndarray, pa.LargeBinaryArray]:
    """A number for each word, equal for equal words only, the words' bounds by text, and the words by number."""
    starts, ends = texts.spans(~_SPACE[texts.data])
    bounds = np.searchsorted(starts, texts.offsets)
    packed = texts.data[~_SPACE[texts.data]]
    places = running(ends - starts)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), bounds, found.dictionary


def _pairs(bounds: np.ndarray, p: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points of each (period, text): the point, the period and which of the (period, text) it is of."""
    n = bounds[text + 1] - bounds[text]
    many = (n - p - 1) // (3 * p) + 1
    which = np.repeat(np.arange(len(p)), many)
    point = bounds[text][which] + (np.arange(len(which)) - np.repeat(running(many)[:-1], many)) * 3 * p[which]
    return point, p[which], which


def _blocks(bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, text) for all periods a run may have, texts in order, in blocks of about most grid points."""
    n = np.diff(bounds)
    last = np.where(n >= LEAST_WORDS, n // LEAST_PERIODS, 0)
    at = np.flatnonzero(last)
    while len(at):
        # whole texts while they are small; a long text by stretches of periods
        cost = (n[at] / 3 * (np.log(np.maximum(last[at], 1)) + 1) + last[at]).astype(np.int64)
        to = max(1, int(np.searchsorted(np.cumsum(cost), most, "right")))
        some, at = at[:to], at[to:]
        if to > 1 or cost[0] <= most:
            many = last[some]
            yield np.arange(many.sum()) - np.repeat(running(many)[:-1], many) + 1, np.repeat(some, many)
            continue
        p = 1
        while p <= last[some[0]]:
            end = int(min(last[some[0]], max(p, p * most * 3 // max(int(n[some[0]]), 1), p + most // 64)))
            yield np.arange(p, end + 1), np.full(end - p + 1, some[0])
            p = end + 1


class _Hashes:
    """Prefix hashes of numbered words: equal stretches have equal hashes, unequal ones almost always unequal ones."""

    def __init__(self, ids: np.ndarray) -> None:
        self.power = np.full(len(ids) + 1, _STEP, U)
        self.power[:1] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(len(ids) + 1, U)
        np.cumsum(mix(ids.astype(U) + U(1)) * self.power[:-1], out=self.sums[1:])

    def alike(self, a: np.ndarray, lag: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from a on are, by their hashes, those from a + lag on."""
        b = a + lag
        return (self.sums[a + n] - self.sums[a]) * self.power[lag] == self.sums[b + n] - self.sums[b]

    def extend(self, a: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest n up to most so that n words from a on (or before a) are those lag words on. All at once."""
        low, high = np.zeros_like(most), most + 1
        while True:
            open_ = np.flatnonzero(high - low > 1)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_]) >> 1
            same = self.alike(a[open_] - mid if back else a[open_], lag[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same]


def _differs(ids: np.ndarray, start: np.ndarray, end: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether a word within start .. end - p is another one than that p words on; BLOCK words at a time."""
    found = np.zeros(len(start), bool)
    many = end - p - start
    at, ends = 0, np.cumsum(many)
    while at < len(start):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        which = np.repeat(np.arange(at, to), many[at:to])
        place = np.arange(len(which)) - np.repeat(running(many[at:to])[:-1], many[at:to]) + start[which]
        found[which[ids[place] != ids[place + p[which]]]] = True
        at = to
    return found


def _anew(ids: np.ndarray, low: int, high: int, p: int) -> np.ndarray:
    """Start, end and period of the long stretches of period p in ids[low:high], by comparing words."""
    same = np.flatnonzero(np.diff(np.concatenate([[0], (ids[low : high - p] == ids[low + p : high]).view(np.int8), [0]])))
    start, end = low + same[::2], low + same[1::2] + p
    long = end - start >= max(LEAST_WORDS, LEAST_PERIODS * p)
    return np.stack([start[long], end[long], np.full(long.sum(), p)], axis=1)


def find_runs(ids: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """start, end and period of every run of the texts ids[bounds[i]:bounds[i + 1]], by start and period; places in ids.

    Numbers need not be those of words: any whole numbers are compared. A text of fewer than six has no run.
    """
    hashes = _Hashes(ids)
    found: list[np.ndarray] = []
    for p, text in _blocks(bounds, block):
        point, lag, which = _pairs(bounds, p, text)
        hit = np.flatnonzero(ids[point] == ids[point + lag])
        if not len(hit):
            continue
        point, lag, of = point[hit], lag[hit], text[which[hit]]
        ahead = hashes.extend(point, lag, bounds[of + 1] - point - lag, False)
        behind = hashes.extend(point, lag, point - bounds[of], True)
        start, end = point - behind, point + lag + ahead
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag)
        if long.any():
            found.append(np.unique(np.stack([start[long], end[long], lag[long]], axis=1), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    while True:
        first = np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1)) if len(runs) else np.zeros(0, bool)
        wrong = np.zeros(len(runs), bool)
        wrong[first] = _differs(ids, *runs[first].T)
        if not wrong.any():
            runs = runs[first]
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        mended = [runs[~wrong]]
        for start, _, p in runs[wrong]:
            i = int(np.searchsorted(bounds, start, "right")) - 1
            mended.append(_anew(ids, int(bounds[i]), int(bounds[i + 1]), int(p)))
        runs = np.unique(np.concatenate(mended), axis=0)


def _kept(runs: np.ndarray, n: int) -> np.ndarray:
    """True for each of n words that no run holds after its first period."""
    change = np.bincount(runs[:, 0] + runs[:, 2], minlength=n + 1) - np.bincount(runs[:, 1], minlength=n + 1)
    return np.cumsum(change)[:n] == 0


def _joined(words: pa.LargeBinaryArray, ids: np.ndarray) -> bytes:
    return b" ".join(words.take(pa.array(ids)).to_pylist())


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_binary())])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row of docs (doc_id, text).

    start is a word's number within its text, from 0. collapsed is UTF-8: the words joined by one space, but for those
    that a run holds after its first period. A null or empty text has no words, no runs and an empty collapsed text;
    repeated rows and null ids are answered row by row; a very long text is worked on in blocks; ties do not occur, as no
    two runs of a text have the same start and period. An empty table gives an empty one. Columns other than doc_id and
    text are not looked at, whatever their names.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, bounds, words = word_numbers(Texts.of(batch.column("text")))
            runs = find_runs(ids, bounds)
            keep = np.flatnonzero(_kept(runs, len(ids)))
            kept, at = np.searchsorted(keep, bounds), np.searchsorted(runs[:, 0], bounds)
            own = runs[:, 0] - np.repeat(bounds[:-1], np.diff(at))
            parts = [pa.array(x) for x in (own, runs[:, 1] - runs[:, 0], runs[:, 2])]
            listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            texts = pa.array([_joined(words, ids[keep[kept[i] : kept[i + 1]]]) for i in range(batch.num_rows)], pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), listed, texts], schema=_SCHEMA)
        release()

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    )


def looped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with planted runs: with h the CRC-32 of the decimal doc_id and g = h // 10, every text with
    h % 10 = 0 and n > 0 words repeats from its word a = g % n on with period 1 + (n - a) // (3 + g % 8), as long as it was.

    A changed text has one space between its words. A row without an id is not changed, and a text without words neither.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            h = [1 if i is None else zlib.crc32(str(i).encode()) for i in batch.column("doc_id").to_pylist()]
            changed = {}
            for i in (i for i, x in enumerate(h) if x % 10 == 0):
                ids, bounds, words = word_numbers(Texts.of(texts.slice(i, 1)))
                n, g = len(ids), h[i] // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    place = np.arange(n)
                    changed[i] = _joined(words, ids[np.where(place < a, place, a + (place - a) % p)]).decode()
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, text string")


def digests(found: DataFrame) -> DataFrame:
    """What periodic_runs found, in numbers: n_runs, the longest run (ties: smallest start, then period; nulls without any) and SHA-256 of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for runs, text in zip(batch.column("runs").to_pylist(), batch.column("collapsed").to_pylist(), strict=True):
                best = min(runs, key=lambda r: (-r["length"], r["start"], r["period"]), default=None)
                told = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
                longest = (best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4
                rows.append((len(runs), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return found.mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('256') else 'bigint'}" for n in names))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(looped(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
