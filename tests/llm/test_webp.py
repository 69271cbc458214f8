"""Lossless WebP: a known file, round trips, and a stream with every feature of the format."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lodeflow.llm import media_columns as M
from lodeflow.llm import webp_lossless as W


def test_known_file():
    assert W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[[0, 0, 0, 0]]]


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 90, 256])
def test_samples_round_trip(colours):
    rng = np.random.default_rng(colours)
    for rows in (1, 2, 3, 40, 1024):
        samples = rng.choice(rng.permutation(256)[:colours], 64 * rows, p=rng.dirichlet(np.full(colours, 0.2))).astype(np.uint8)
        if rows > 2:
            samples[70:-70] = np.repeat(samples[70 : 70 + (len(samples) - 140 + 30) // 31], 31)[: len(samples) - 140]
        image = W.decode(W.encode_samples(samples, 64))
        assert (image[..., 0] == 255).all() and all((image[..., c].reshape(-1) == samples).all() for c in (1, 2, 3))


def predict(mode, image, y, x):
    """Plain version of the predictor for one pixel of an int array."""
    w = image.shape[1]
    if y == 0 and x == 0:
        return np.array([255, 0, 0, 0])
    if y == 0:
        return image[0, x - 1]
    if x == 0:
        return image[y - 1, 0]
    left, top, corner = image[y, x - 1], image[y - 1, x], image[y - 1, x - 1]
    right = image[y - 1, x + 1] if x + 1 < w else image[y, 0]
    mean = lambda a, b: (a + b) // 2
    if mode == 11:
        p = left + top - corner
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    half = mean(left, top)
    trunc = np.array([int((int(a) - int(c)) / 2) for a, c in zip(half, corner, strict=True)])
    return {
        0: np.array([255, 0, 0, 0]), 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: half, 8: mean(corner, top),
        9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)), 12: np.clip(left + top - corner, 0, 255), 13: np.clip(half + trunc, 0, 255),
    }[mode]


def s8(v):
    return int(v) - 256 if v > 127 else int(v)


class Writer:
    """Flat prefix codes for any symbols."""

    def __init__(self):
        self.out = W.Out()

    def codes(self, cache):
        green = np.full(280 + cache, 8)
        extra = 2 * (24 + cache)
        green[-extra:] = 9
        distance = np.array([5] * 24 + [6] * 16)
        flat = np.full(256, 8)
        self.lengths = (green, flat, flat, flat, distance)
        self.values = [W.code_values(x) for x in self.lengths]
        for x in self.lengths:
            W.write_code(self.out, x)

    def symbol(self, k, s):
        self.out.put(int(self.values[k][s]), int(self.lengths[k][s]))

    def number(self, k, base, value):
        s, extra, n = (int(x) for x in W.prefix_of(value))
        self.symbol(k, base + s)
        self.out.put(extra, n)

    def image(self, pixels, width, cache_bits=0, meta_bits=0, rng=None):
        """pixels: rows of (a, r, g, b). With rng: copies and the colour cache where they fit."""
        flat = [tuple(int(c) for c in p) for p in pixels.reshape(-1, 4)]
        self.out.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.out.put(cache_bits, 4)
        if meta_bits is not None:
            self.out.put(1 if meta_bits else 0, 1)
            if meta_bits:
                self.out.put(meta_bits - 2, 3)
                across, down = -(-width >> meta_bits), -(-(len(flat) // width) >> meta_bits)
                groups = np.zeros((down, across, 4), int)
                groups[..., 2] = (np.arange(down)[:, None] + np.arange(across)) % 2
                self.image(groups, across, meta_bits=None)
        cache_size = (1 << cache_bits) if cache_bits else 0
        for _ in range(2 if meta_bits else 1):
            self.codes(cache_size)
        cache, at = {}, 0

        def keep(p):
            if cache_bits:
                cache[((p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) * W.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p

        while at < len(flat):
            p = flat[at]
            copied = False
            if rng:
                for code in rng.sample(range(1, 121), 40) + [120 + rng.randrange(1, 60)]:
                    back = W._distance(code, width)
                    n = 0
                    while back <= at and at + n < len(flat) and flat[at + n] == flat[at + n - back]:
                        n += 1
                    if n >= 2:
                        self.number(0, 256, n)
                        self.number(4, 0, code)
                        for q in flat[at : at + n]:
                            keep(q)
                        at += n
                        copied = True
                        break
            if copied:
                continue
            slot = ((p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]) * W.CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if cache_bits and cache.get(slot) == p:
                self.symbol(0, 280 + slot)
            else:
                for k, c in ((0, 2), (1, 1), (2, 3), (3, 0)):
                    self.symbol(k, p[c])
            keep(p)
            at += 1


@pytest.mark.parametrize("seed", range(8))
def test_every_feature(seed):
    rng, plain = np.random.default_rng(seed), random.Random(seed)
    height, width = (23, 19) if seed % 2 else (12, 33)
    image = rng.integers(0, 256, (height, width, 4)) if seed % 4 == 0 else rng.integers(0, 3, (height, width, 4)) * 60
    image[height // 2 :, : width // 2] = image[0, 0]
    image[-2:] = image[1:3]
    writer, work = Writer(), image.copy()
    writer.out.put(width - 1, 14)
    writer.out.put(height - 1, 14)
    writer.out.put(1, 1)
    writer.out.put(0, 3)
    order = [2, 1, 0] if seed % 3 else [0, 1, 2]
    for kind in order:
        writer.out.put(1, 1)
        writer.out.put(kind, 2)
        down, across = -(-height >> 2), -(-width >> 2)
        if kind == 2:
            work[..., 1] = (work[..., 1] - work[..., 2]) % 256
            work[..., 3] = (work[..., 3] - work[..., 2]) % 256
            continue
        data = rng.integers(0, 256, (down, across, 4))
        if kind == 0:
            data[..., 2] = rng.integers(0, 14, (down, across))
        writer.out.put(0, 3)
        writer.image(data, across, meta_bits=None)
        before = work.copy()
        for y in range(height):
            for x in range(width):
                block = data[y >> 2, x >> 2]
                if kind == 0:
                    work[y, x] = (before[y, x] - predict(int(block[2]), before, y, x)) % 256
                else:
                    _, red, green, blue = (int(c) for c in before[y, x])
                    work[y, x, 1] = (red - (s8(block[3]) * s8(green) >> 5)) % 256
                    work[y, x, 3] = (blue - (s8(block[2]) * s8(green) >> 5) - (s8(block[1]) * s8(red) >> 5)) % 256
    writer.out.put(0, 1)
    cache, meta = [(0, 0), (5, 0), (0, 2), (7, 3)][seed % 4]
    writer.image(work, width, cache, meta, plain)
    body = b"\x2f" + writer.out.value.to_bytes((writer.out.size + 7) // 8, "little")
    body += b"\0" * (len(body) % 2)
    file = b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
    assert (W.decode(file) == image).all()


def test_code_lengths_are_complete_and_limited():
    for counts in ([1, 1], [1] * 300, [2**k for k in range(40)], [0, 5, 0, 1, 1]):
        lengths = W.code_lengths(np.array(counts), 15)
        used = lengths[lengths > 0]
        assert used.max() <= 15 and sum(2.0 ** -int(x) for x in used) == 1 and ((lengths > 0) == (np.array(counts) > 0)).all()


def test_broken_files():
    with pytest.raises(ValueError):
        W.decode(b"RIFF no image at all....")
    whole = W.encode_samples(np.arange(64, dtype=np.uint8), 64)
    with pytest.raises(ValueError):
        W.decode(whole[:30])


def test_media_columns(spark):
    texts = ["", None, "x" * 64, "é" * 200, "ab\n" * 50000, "x" * 64]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = M.store(rows)
    found = {r.doc_id: r for r in M.digests(stored).collect()}
    for i, t in enumerate(texts):
        payload = M.padded((t or "").encode())
        r = found[i]
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(payload)) and len(payload) % 64 == 0 and payload
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert found[2].feature == found[5].feature and found[0].media_sha256 == found[1].media_sha256
    pixels = M.pixels(stored.where("doc_id = 4")).orderBy("file").collect()
    grey = b"".join(np.frombuffer(r.argb, np.uint8).reshape(-1, 4)[:, 2].tobytes() for r in pixels)
    assert grey == M.padded(texts[4].encode()) and len(pixels) == 3
    assert M.digests(M.store(rows.limit(0))).count() == 0
