"""Encoding with and decoding from a SentencePiece vocabulary.

An Aho-Corasick automaton over the pieces reads a text once. At each position its output links give every piece
that ends there, and each relaxes the best score of a segmentation of the text so far. A character that no piece
covers falls back to its bytes. Where no piece can cross a place (before a run of spaces, around a new line), the
best segmentation of the whole is made of the best ones of its parts, so parts are segmented once a worker. The
automaton is also held as arrays: the parts of a slice of texts that are still unknown take each step together.

The scores are those that the vocabulary file holds. Where these are merge ranks instead of log-probabilities, as in
the vocabulary that op6 reads, their sum is still what is maximised, but the pieces then differ from those of the
vocabulary's own encoder, which merges by rank. Decoding gives every text back either way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.words import running, slices

SPACE = "▁"
_CACHE_PARTS = 300_000
_CACHE_POINTS = 8 << 20  # of the cached parts, in code points
_FEWEST = 64  # parts that a common step pays for; longer parts than all but so many go one by one
_LONGEST = 4096  # code points of a part that goes with others
_CELLS = 1 << 19  # parts times code points that go together
_STRETCHES = 1 << 16  # copied at once


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at start, one after another."""
    found = [values[:0]]
    for at in range(0, len(size), _STRETCHES):
        some = size[at : at + _STRETCHES]
        before = running(some)
        found.append(values[np.repeat(start[at : at + _STRETCHES] - before[:-1], some) + np.arange(before[-1])])
    return np.concatenate(found)


class _Numbers(dict[str, int]):
    """Numbers parts from 0 as they are asked for."""

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        return n


class Steps:
    """An Aho-Corasick automaton in arrays, which takes a step for many texts at once.

    Nodes are the beginnings of pieces, by length and then by character, so that the edges, sorted by node and
    character, lead to nodes 1, 2, 3 and so on. Node 0 is the empty beginning; it also stands for no piece.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        chars = sorted({c for piece in pieces for c in piece})
        #: Number of a code point among the characters of pieces; 0 for all others.
        self.number = np.zeros(0x110000, np.int64)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        levels: list[list[str]] = [[""]]
        while levels[-1]:
            n = len(levels)
            levels.append(sorted({piece[:n] for piece in pieces if len(piece) >= n}))
        nodes = {start: i for i, start in enumerate(p for level in levels for p in level)}
        self.size = np.array([max(len(p), 1) for p in nodes], np.int64)  # without a piece, one character
        self.piece = np.array([pieces.get(p, (-1, 0.0))[0] for p in nodes], np.int32)
        self.score = np.array([pieces.get(p, (-1, 0.0))[1] for p in nodes])
        above = np.array([0] + [nodes[p[:-1]] for p in nodes if p], np.int64)
        last = np.array([0] + [self.number[ord(p[-1])] for p in nodes if p], np.int64)
        self.edges = np.append(above[1:] * self.width + last[1:], np.iinfo(np.int64).max)
        #: Longest other node that a node ends with, longest piece that it ends with, next longest of these.
        self.fail, self.longest, self.shorter = (np.zeros(len(nodes), np.int64) for _ in range(3))
        at = 1
        for n, level in enumerate(levels[1:], 1):
            here = slice(at, at := at + len(level))
            if n > 1:
                self.fail[here] = self.step(self.fail[above[here]], last[here])
            self.shorter[here] = self.longest[self.fail[here]]
            self.longest[here] = np.where(self.piece[here] >= 0, np.arange(here.start, at), self.shorter[here])

    def step(self, node: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Where each node gets with a character."""
        reached = np.zeros(len(node), np.int64)
        left = np.arange(len(node))
        while len(left):
            edge = node * self.width + number
            at = np.searchsorted(self.edges, edge)
            there = self.edges[at] == edge
            reached[left[there]] = at[there] + 1
            more = ~there & (node > 0)
            left, node, number = left[more], self.fail[node[more]], number[more]
        return reached


class PieceModel:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        size = model.get_piece_size()
        self.scores = np.zeros(size)
        self.surface: list[bytes] = [b""] * size
        self.byte_ids = [-1] * 256
        normal: dict[str, tuple[int, float]] = {}
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                self.scores[i] = model.get_score(i)
                normal[piece] = i, self.scores[i]
                self.automaton.add_word(piece, (i, len(piece), self.scores[i]))
                self.surface[i] = piece.replace(SPACE, " ").encode()
        self.automaton.make_automaton()
        self.steps = Steps(normal)
        #: Of a text as it is written: a space is a lower block, and a lower block is no space.
        self.number = self.steps.number.copy()
        self.number[[ord(" "), ord(SPACE)]] = self.steps.number[[ord(SPACE), 0]]
        #: Score of a character without a piece, below that of any piece.
        self.fallback = float(self.scores.min()) - 10
        self.is_byte = np.zeros(size, bool)
        self.is_byte[[i for i in self.byte_ids if i >= 0]] = True
        crossing = any(SPACE in p.lstrip(SPACE) for p in normal)
        breaking = any("\n" in p for p in normal)
        self.split = re.compile("(?s).+" if crossing else "(?s) *[^ ]+| +" if breaking else "\n| *[^ \n]+| +")
        self.surface_size = np.array([len(x) for x in self.surface], np.int64)
        self.surface_start = running(self.surface_size)[:-1]
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.forget()

    def forget(self) -> None:
        #: Known parts, by number; their ids stand in known_ids.
        self.known, self.known_points = _Numbers(), 0
        self.known_ids, self.known_start, self.known_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def segment(self, part: str) -> list[int]:
        """Best ids of part; of equally good segmentations, that which a longer last piece gives."""
        text = part.replace(SPACE, "\0").replace(" ", SPACE)  # a written lower block is no space
        best, last = [0.0] + [-np.inf] * len(text), [(-1, 1)] * (len(text) + 1)
        ready = 0
        for end, (i, size, score) in self.automaton.iter(text):
            while ready < end:
                ready += 1
                if best[ready] < best[ready - 1] + self.fallback:
                    best[ready], last[ready] = best[ready - 1] + self.fallback, (-1, 1)
            reached = best[end + 1 - size] + score
            if reached > best[end + 1]:
                best[end + 1], last[end + 1] = reached, (i, size)
        while ready < len(text):
            ready += 1
            if best[ready] < best[ready - 1] + self.fallback:
                best[ready], last[ready] = best[ready - 1] + self.fallback, (-1, 1)
        ids: list[int] = []
        at = len(text)
        while at:
            i, size = last[at]
            at -= size
            ids += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(part[at].encode())]
        return ids[::-1]

    def segment_together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What segment gives for each part, longest parts first: all ids, and how many each part has."""
        steps, rows = self.steps, len(parts)
        lengths = np.array([len(p) for p in parts], np.int64)
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        place = np.arange(len(points)) - np.repeat(running(lengths)[:-1], lengths)
        text = np.zeros((lengths[0], rows), np.uint32)
        text[place, np.repeat(np.arange(rows), lengths)] = points
        best = np.full((lengths[0] + 1, rows), -np.inf)
        last = np.zeros((lengths[0] + 1, rows), np.int32)
        best[0] = 0
        node = np.zeros(rows, np.int64)
        for k, n in enumerate(np.searchsorted(-lengths, -np.arange(lengths[0])).tolist()):
            node = steps.step(node[:n], self.number[text[k, :n]])
            top, choice = best[k + 1], last[k + 1]
            piece = steps.longest[node]
            row = np.flatnonzero(piece)
            piece = piece[row]
            while len(row):
                score = best.ravel()[(k + 1 - steps.size[piece]) * rows + row] + steps.score[piece]
                better = score > top[row]
                top[row[better]], choice[row[better]] = score[better], piece[better]
                piece = steps.shorter[piece]
                row, piece = row[piece > 0], piece[piece > 0]
            alone = best[k, :n] + self.fallback
            row = np.flatnonzero(top[:n] < alone)
            top[row], choice[row] = alone[row], 0
        used = np.full((rows, lengths[0] + 1), -1, np.int32)  # the piece that ends here
        row, at = np.arange(rows), lengths
        while len(row):
            piece = last[at, row]
            used[row, at] = piece
            at = at - steps.size[piece]
            row, at = row[at > 0], at[at > 0]
        row, at = np.nonzero(used >= 0)
        piece = used[row, at]
        size = np.ones(len(row), np.int64)
        alone = np.flatnonzero(piece == 0)
        chars, which = np.unique(text[at[alone] - 1, row[alone]], return_inverse=True)
        coded = [[self.byte_ids[b] for b in chr(c).encode()] for c in chars.tolist()]
        size[alone] = np.array([len(c) for c in coded], np.int64)[which]
        start = running(size)
        ids = np.repeat(steps.piece[piece], size)
        table = np.array([c + [0] * (4 - len(c)) for c in coded], np.int32).reshape(-1, 4)
        for j in range(4):
            some = size[alone] > j
            ids[start[alone[some]] + j] = table[which[some], j]
        return ids, np.diff(start[np.searchsorted(row, np.arange(rows + 1))])

    def learn(self, parts: list[str]) -> None:
        """Segment parts that have just got their numbers, most of them together."""
        lengths = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        usual = min(int(lengths[_FEWEST - 1]), _LONGEST) if len(parts) >= _FEWEST else 0
        at = int(np.count_nonzero(lengths > usual))
        alone = [self.segment(parts[i]) for i in order[:at].tolist()]
        ids, sizes = [np.array([i for some in alone for i in some], np.int32)], [np.array([len(some) for some in alone], np.int64)]
        while at < len(parts):
            to = at + _CELLS // (int(lengths[at]) + 1)
            for found, every in zip((ids, sizes), self.segment_together([parts[i] for i in order[at:to].tolist()]), strict=True):
                found.append(every)
            at = to
        size = np.concatenate(sizes)
        start = len(self.known_ids) + running(size)[:-1]
        back = np.argsort(order)
        self.known_ids = np.concatenate([self.known_ids, *ids])
        self.known_start, self.known_size = np.append(self.known_start, start[back]), np.append(self.known_size, size[back])
        self.known_points += int(lengths.sum())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """int32 ids of all texts, and how many each has; a text gets one space in front, an empty one has no ids."""
        if len(self.known) > _CACHE_PARTS or self.known_points > _CACHE_POINTS:
            self.forget()
        known = len(self.known_size)
        number = self.known.__getitem__
        parts = [np.zeros(0, np.int64)]
        for text in texts:
            some = self.split.findall(" " + text) if text else []
            parts.append(np.fromiter(map(number, some), np.int64, len(some)))
        if len(self.known) > known:
            self.learn(list(islice(self.known, known, None)))
        part = np.concatenate(parts)
        size = self.known_size[part]
        ends = running(size)[np.cumsum([len(some) for some in parts])]
        return _gather(self.known_ids, self.known_start[part], size), np.diff(ends)

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, one after another."""
        return _gather(self.surface_bytes, self.surface_start[ids], self.surface_size[ids]).tobytes()

    def decode(self, ids: list[int]) -> str:
        """The exact text that encode was given."""
        surface = self.surface
        return b"".join([surface[i] for i in ids])[1:].decode()


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One for each worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """ids (array of int) of every row's whole text, their score, how many are bytes, and whether they decode to the text.

    A null text is an empty one, which has no ids. Repeated rows and null doc_ids each get their row; an empty
    table gives an empty one; columns other than doc_id and text are not read. A very long text is coded whole, part by
    part; a part is what stands between places that no piece spans.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids, n = model.encode(texts)
            bounds = running(n)
            byte = np.diff(running(model.is_byte[ids])[bounds])
            score = np.diff(running(np.where(model.is_byte[ids], 0.0, model.scores[ids]))[bounds])
            spelled, ends = model.spell(ids), running(model.surface_size[ids])[bounds].tolist()
            same = [spelled[a + 1 : b].decode() == t for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    pa.array(n),
                    pa.array(byte.astype(np.int64)),
                    pa.array(score),
                    pa.array(same),
                ],
                names=["doc_id", "ids", "n_ids", "n_bytes", "score", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, n_ids bigint, n_bytes bigint, score double, round_trip boolean")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text, no ids an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def public_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_pieces())
