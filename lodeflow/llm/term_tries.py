"""Radix tries over the bytes of terms, laid out in traversal order, with document counts and per-source leaf counters.

A trie's leaves are its terms in the order of their UTF-8 bytes. Each leaf holds the depth at which its path leaves that of
the leaf before it and the bytes from there on (its edge), so a shared prefix stands once. Beside it stand the number of
documents with the term and the term's counts by source, none of them 0. Tries merge by adding up leaves of equal paths.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodeflow.llm.words import running

_HEAD = struct.Struct("<4q")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])


def _bytes_of(terms: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all terms one after the other, and their bounds."""
    if not len(terms):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = terms.buffers()
    ends = np.frombuffer(ends, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + lengths[i], one stretch after the other."""
    return np.arange(lengths.sum()) - np.repeat(running(lengths)[:-1], lengths) + np.repeat(starts, lengths)


def shared_depths(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each term how many first bytes it has in common with the term before it; 0 for the first."""
    n = len(bounds) - 1
    depth = np.zeros(n, np.int64)
    if n < 2:
        return depth
    most = np.minimum(np.diff(bounds)[1:], np.diff(bounds)[:-1])
    open_ = np.flatnonzero(most > 0) + 1
    k = 0
    while len(open_):
        same = data[bounds[open_] + k] == data[bounds[open_ - 1] + k]
        open_ = open_[same]
        depth[open_] += 1
        k += 1
        open_ = open_[most[open_ - 1] > k]
    return depth


@dataclass
class Trie:
    """Leaves in order: terms, docs (documents with the term), and counts[ptr[i]:ptr[i + 1]] by source (numbers) of leaf i."""

    terms: pa.LargeBinaryArray
    docs: np.ndarray
    ptr: np.ndarray
    sources: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.terms)

    @classmethod
    def grown(cls, terms: pa.LargeBinaryArray, docs: np.ndarray, leaf: np.ndarray, sources: np.ndarray, counts: np.ndarray) -> Trie:
        """From terms in any order, the same one more than once maybe: docs of each, and a count for each (leaf, source), leaf being a place in terms."""
        coded = terms.dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        order = pc.sort_indices(words).to_numpy().astype(np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[code]
        summed = np.zeros(len(order), np.int64)
        np.add.at(summed, at, docs)
        width = int(sources.max()) + 1 if len(sources) else 1
        key, which = np.unique(at[leaf] * width + sources, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, which, counts)
        return cls(words.take(pa.array(order)), summed, np.searchsorted(key, np.arange(len(order) + 1) * width), key % width, total)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """The sum of tries whose sources have the same numbers."""
        if len(tries) == 1:
            return tries[0]
        sizes = [len(t) for t in tries]
        leaf = np.concatenate([np.repeat(np.arange(len(t)), np.diff(t.ptr)) + at for t, at in zip(tries, running(np.array(sizes)), strict=False)])
        joined = pa.concat_arrays([t.terms for t in tries])
        return cls.grown(joined, np.concatenate([t.docs for t in tries]), leaf, np.concatenate([t.sources for t in tries]), np.concatenate([t.counts for t in tries]))

    def leaves(self, low: int, high: int) -> Trie:
        a, b = self.ptr[low], self.ptr[high]
        return Trie(self.terms.slice(low, high - low), self.docs[low:high], self.ptr[low : high + 1] - a, self.sources[a:b], self.counts[a:b])

    def kept(self, some: np.ndarray) -> Trie:
        """The leaves at places some, in order."""
        many = np.diff(self.ptr)[some]
        at = _spread(self.ptr[some], many)
        return Trie(self.terms.take(pa.array(some)), self.docs[some], running(many), self.sources[at], self.counts[at])

    def renumbered(self, number: np.ndarray) -> Trie:
        return Trie(self.terms, self.docs, self.ptr, number[self.sources], self.counts)

    def branches(self, depth: int) -> list[tuple[bytes, int, int]]:
        """The subtrees at depth bytes: prefix, first leaf, end. A term of fewer bytes is a branch of its own, with a shorter prefix."""
        data, bounds = _bytes_of(self.terms)
        first = np.flatnonzero(np.append(True, shared_depths(data, bounds)[1:] < depth)).tolist() if len(self) else []
        return [(data[bounds[a] : min(bounds[a] + depth, bounds[a + 1])].tobytes(), a, b) for a, b in zip(first, [*first[1:], len(self)], strict=True)]

    def packed(self) -> bytes:
        """In bytes: each leaf by depth and edge."""
        data, bounds = _bytes_of(self.terms)
        depth = shared_depths(data, bounds)
        own = np.diff(bounds) - depth
        edges = data[_spread(bounds[:-1] + depth, own)]
        parts = [depth.astype(np.uint32), own.astype(np.uint32), self.docs, np.diff(self.ptr).astype(np.uint32), self.sources.astype(np.uint32), self.counts, edges]
        return _HEAD.pack(len(self), len(self.sources), len(edges), 0) + b"".join(np.ascontiguousarray(x).tobytes() for x in parts)

    @classmethod
    def unpacked(cls, stored: bytes) -> Trie:
        n, pairs, size, _ = _HEAD.unpack_from(stored)
        at = _HEAD.size
        parts = []
        for kind, many in ((np.uint32, n), (np.uint32, n), (np.int64, n), (np.uint32, n), (np.uint32, pairs), (np.int64, pairs), (np.uint8, size)):
            parts.append(np.frombuffer(stored, kind, many, at))
            at += parts[-1].nbytes
        depth, own, docs, many, sources, counts, edges = parts
        depth, own = depth.astype(np.int64), own.astype(np.int64)
        bounds = running(depth + own)
        data = np.zeros(int(bounds[-1]), np.uint8)
        data[_spread(bounds[:-1] + depth, own)] = edges
        open_, k = np.flatnonzero(depth), 0
        while len(open_):  # byte k of a leaf whose path left the one before it below k is that leaf's, down a run of such leaves
            first = np.append(True, np.diff(open_) > 1)
            before = (open_[first] - 1)[np.cumsum(first) - 1]
            data[bounds[open_] + k] = data[bounds[before] + k]
            k += 1
            open_ = open_[depth[open_] > k]
        return cls(_binary(data, bounds), docs, running(many.astype(np.int64)), sources.astype(np.int64), counts)

    def dense(self, low: int, high: int, width: int) -> np.ndarray:
        """Counts of the leaves low .. high by source, a row for each leaf."""
        table = np.zeros((high - low, width), np.int64)
        a, b = self.ptr[low], self.ptr[high]
        table[np.repeat(np.arange(high - low), np.diff(self.ptr[low : high + 1])), self.sources[a:b]] = self.counts[a:b]
        return table
