"""Media columns: lossless WebP images in binary columns, written and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeflow.llm.webp_lossless import decode, encode_samples
from lodeflow.llm.words import slices

WIDTH = 64
#: Rows of an image at most; a longer payload is stored as several files one after the other.
ROWS = 1024


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_payload(payload: bytes) -> bytes:
    """A payload of whole rows as one or more lossless WebP files of grey pixels, a sample for each byte."""
    step = WIDTH * ROWS
    samples = np.frombuffer(payload, np.uint8)
    return b"".join(encode_samples(samples[at : at + step], WIDTH) for at in range(0, len(samples), step))


def files(media: bytes) -> Iterator[bytes]:
    """The WebP files that stand one after the other in media."""
    at = 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at:end]
        at = end


def decode_payload(media: bytes) -> np.ndarray:
    """The grey samples of all files, row by row."""
    return np.concatenate([decode(f)[..., 2].reshape(-1) for f in files(media)])


def feature(samples: np.ndarray) -> str:
    """Which of 16 even bands is brighter than the one before (the first than the last), and the share of 16 grey ranges, in hex."""
    bands = np.add.reduceat(samples.astype(np.int64), np.arange(16) * len(samples) // 16) / np.diff(np.arange(17) * len(samples) // 16)
    rises = int(np.packbits(bands > np.roll(bands, 1)).view(">u2")[0])
    share = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{rises:04x}" + bytes(share.astype(np.uint8)).hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every row of docs (doc_id, text): its whole text as lossless WebP.

    A null text is stored as an empty one. Repeated rows and null ids each get their row; an empty table gives an
    empty one; other columns are not read. A very long text is several files of ROWS rows, made one after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            media = [encode_payload(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def pixels(stored: DataFrame) -> DataFrame:
    """doc_id, file, height, width and argb (bytes A, R, G, B of each pixel) of every file in every row of stored (doc_id, media).

    A null or empty media has no files and gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, media in zip(batch.column("doc_id"), batch.column("media").to_pylist(), strict=True):
                for file, whole in enumerate(files(media or b"")):
                    image = decode(whole)
                    columns = [pa.array([doc_id.as_py()], pa.int64()), *(pa.array([n], pa.int32()) for n in (file, *image.shape[:2])), pa.array([image.tobytes()])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "height", "width", "argb"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id bigint, file int, height int, width int, argb binary")


def digests(stored: DataFrame) -> DataFrame:
    """What stored media (doc_id, n_bytes, media) say when read back; null media give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                if not media:
                    rows.append((None,) * 6)
                    continue
                samples = decode_payload(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
