"""Whole Arrow batches of texts as flat numpy arrays: words, lines and their 64-bit hashes.

All functions see every byte of every text. A null text counts as an empty one. White space is the six
ASCII characters space, tab, \\n, \\v, \\f and \\r; UTF-8 never uses their bytes inside another character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 2 << 20  # of text worked on at once; one longer text is a slice of its own
_SEGMENT_BYTES = 4 << 20  # of a text hashed at once; a longer word or line is a segment of its own
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ORDER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], U)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close inputs get unrelated outputs."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


#: What a worker keeps for later tasks, by kind: how it is forgotten.
_kept: dict[str, Callable[[], None]] = {}


def keep(kind: str, forget: Callable[[], None]) -> None:
    """Say that this process now keeps something that tasks of other kinds have no use for."""
    _kept[kind] = forget


def release(kind: str = "") -> None:
    """Give back to the system what earlier work of this process has left unused, and what it keeps for other kinds of tasks."""
    for other in [k for k in _kept if k != kind]:
        _kept.pop(other)()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about limit bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Texts:
    """The UTF-8 bytes of some texts one after the other; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(data[offsets[0] : offsets[-1]], offsets - offsets[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """With A-Z in lower case, and nothing else changed."""
        return Texts(_LOWER[self.data], self.offsets)

    def per_text(self, values: np.ndarray, positions: np.ndarray | None = None) -> np.ndarray:
        """Sums of values by text; positions: the byte at which each value lies, every byte by default."""
        ends = self.offsets if positions is None else np.searchsorted(positions, self.offsets)
        return running(values)[ends][1:] - running(values)[ends][:-1]

    def spans(self, is_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of is_part within texts."""
        if not len(is_part):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins, ends = is_part.copy(), is_part.copy()
        begins[1:] &= ~is_part[:-1]
        ends[:-1] &= ~is_part[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < len(is_part))]
        begins[edge] |= is_part[edge]
        ends[edge - 1] |= is_part[edge - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[starts:ends], equal for equal bytes wherever they lie; spans in order, none within another.

        Works on one segment of the data after the other, so a very long text needs no arrays of its own length.
        """
        found, at = np.zeros(len(starts), U), 0
        while at < len(starts):
            low = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, low + _SEGMENT_BYTES, "right")))
            part = self.data[low : int(ends[to - 1])]
            power, inverse = _power_tables(len(part) + 1)
            sums = np.zeros(len(part) + 1, U)
            np.cumsum((part.astype(U) + U(1)) * power[: len(part)], out=sums[1:])
            begin, end = starts[at:to] - low, ends[at:to] - low
            found[at:to] = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(U) * _ORDER[0])
            at = to
        return found


def running(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place; sums[j] - sums[i] is the sum of values[i:j]."""
    kind = np.int64 if values.dtype.kind in "bui" else np.float64
    sums = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=sums[1:])
    return sums


@dataclass
class Words:
    """Words of Texts in order: byte spans, hashes, and for text i the words bounds[i] to bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Words:
        starts, ends = texts.spans(~_SPACE[texts.data])
        return cls(starts, ends, texts.hashes(starts, ends), np.searchsorted(starts, texts.offsets))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of size neighbours, in order; runs over a text's end are the caller's to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    total = hashes[:n] * _ORDER[0]
    for j in range(1, size):
        total = total + hashes[j : j + n] * _ORDER[j]
    return mix(total)


def window_starts(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie within a text, and each window's text."""
    fit = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(fit)), fit)
    first = np.repeat(bounds[:-1] - running(fit)[:-1], fit)
    return np.arange(len(text)) + first, text


def within(key: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys made different for different texts."""
    return mix(key ^ (text.astype(U) + U(1)) * _ORDER[1])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
