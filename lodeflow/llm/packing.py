"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

Texts are tokenised word by word: the tokenizer drops white space and never looks across it, so a word's ids do
not depend on its neighbours and are looked up once a worker. Documents are cut at multiples of the sequence
length. A piece of full length is a sequence by itself; what is left of each document goes to a random group of a
bounded number of documents, each of which one task packs by itself.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.words import U, keep, mix, release, slices
from lodeflow.session import bound_batches

CAPACITY = 4096
END_ID = 2
#: Documents that make up a group, about.
GROUP_DOCS = 2048
_FULL_BITS = 12  # full pieces of a task that travel as one group: 2 ** _FULL_BITS
_CACHE_WORDS = 500_000
# The tokenizer's own split of a word, written for printable ASCII and Latin-1 letters; other words go to it whole.
_OTHER = re.compile("[^\n!-~À-ÖØ-öø-ÿ]|<[|]")
_PARTS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
#: Byte-level models spell a byte as the Latin-1 character of its value; those not printable, in order, as the characters from 256 on.
_SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_NO_ID = 0xFFFFFFFF
_BREAK = np.array([_NO_ID], np.uint32).tobytes()


class WordTokenizer:
    """ids of whole texts as little-endian unsigned 32-bit bytes, equal to those of encode(text, add_special_tokens=False)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.model = self.inner.model
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.inner.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        """The tokenizer's model takes a part as it is cut already, its bytes spelt as characters."""
        for part in parts:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(_SPELLING)
            self.parts[part] = array("I", [token.id for token in self.model.tokenize(spelt)]).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        if len(self.words) + len(words) > _CACHE_WORDS:
            self.words.clear()
        if len(self.parts) > _CACHE_WORDS:
            self.parts.clear()
        text = b"\n".join(words).decode("utf-8", "replace")
        if _OTHER.search(text):
            odd = [w for w in words if _OTHER.search(w.decode("utf-8", "replace"))]
            self.words.update(zip(odd, self._encode([w.decode("utf-8", "replace") for w in odd]), strict=True))
            words = list(set(words).difference(odd))
            text = b"\n".join(words).decode()
        parts = _PARTS.findall(text.lower())  # a new line between words is a part of its own
        self._learn_parts(list(set(parts).difference(self.parts, "\n")))
        self.parts["\n"] = _BREAK
        ids = b"".join(map(self.parts.__getitem__, parts))
        ends = np.append(np.flatnonzero(np.frombuffer(ids, np.uint32) == _NO_ID) * 4, len(ids)).tolist()
        at = 0
        for word, end in zip(words, ends, strict=True):
            self.words[word] = ids[at:end]
            at = end + 4

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]  # at ASCII white space
        fresh = set().union(*split).difference(self.words)
        if fresh:
            every = len(self.words) + len(fresh) > _CACHE_WORDS  # the cache starts anew
            self._learn(list(set().union(*split) if every else fresh))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker, until a task of another kind needs the room."""
    keep("tokenizer", _tokenizers.clear)
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first, each into the first bin with room.

    The tree's leaves are the bins' free capacities and each inner node holds the larger of its two; going down
    to the left wherever there is room finds the first bin that fits. Equal lengths keep their order.
    """
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    free = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= length
        node >>= 1
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node >>= 1
    return bins, offsets


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _pieces(docs: DataFrame, tokenizer: str, groups: int, capacity: int, with_ids: bool) -> DataFrame:
    """Every piece with its group: of full ones a negative number, of the rest that of their document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("tokenizer")
        encoder, part = word_tokenizer(tokenizer), TaskContext.get().partitionId() << 40
        close, whole, row, full = np.array([END_ID], np.uint32).tobytes(), 4 * capacity, part, part
        for batch in slices(batches, "text"):
            texts = [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
            totals, crcs, kept = [], [], []
            for ids in encoder.encode(texts):
                view = memoryview(ids + close)
                totals.append(len(view) // 4)
                crcs += [zlib.crc32(view[at : at + whole]) for at in range(0, len(view), whole)]
                if with_ids:
                    kept += [bytes(view[at : at + whole]) for at in range(0, len(view), whole)]
            total = np.array(totals, np.int64)
            owner = np.repeat(np.arange(len(total)), -(-total // capacity))
            start = capacity * (np.arange(len(owner)) - np.searchsorted(owner, owner))
            length = np.minimum(total[owner] - start, capacity)
            is_full = length == capacity
            group = (mix((row + owner).astype(U)) % U(groups)).astype(np.int64)
            group[is_full] = -1 - ((full + np.arange(is_full.sum())) >> _FULL_BITS)
            row, full = row + len(total), full + int(is_full.sum())
            doc_id = batch.column("doc_id").cast(pa.int64()).take(pa.array(owner))
            ids = pa.array(kept, pa.binary()) if with_ids else pa.nulls(len(owner), pa.binary())
            columns = [pa.array(group), doc_id, pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(total[owner]), ids]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"group bigint, {PIECES}, ids binary")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """Every token of every row of docs (doc_id, text) in one piece, every piece in one sequence.

    doc_tokens counts the closing id, which a null or empty text has too. sequence_id is the group times 2**32
    plus the bin, and negative for a full piece; offset is the piece's place in the sequence, gapless from 0. with_ids adds the ids themselves as
    little-endian unsigned 32-bit binary. Repeated and null ids are packed row by row, ties in length in any
    order; a very long text's ids are held whole by the task that cuts them, and its full pieces need no packing;
    an empty table gives an empty one; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    pieces = _pieces(docs, tokenizer, groups, capacity, with_ids)
    pieces = pieces if with_ids else pieces.drop("ids")
    more = ", ids binary" if with_ids else ""

    def place(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        if group < 0:
            sequence, offsets = (group << _FULL_BITS) + np.arange(table.num_rows), np.zeros(table.num_rows, np.int64)
        else:
            bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), capacity)
            sequence = (group << 32) + bins
        out = table.drop_columns(["group"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offsets))

    return pieces.groupBy("group").applyInArrow(place, f"{PIECES}{more}, sequence_id bigint, offset bigint")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
