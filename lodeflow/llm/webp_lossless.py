"""Lossless WebP (RFC 9649): decoding of every feature, and encoding of 8-bit samples.

Decoding reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Where an image has one group of codes and no colour cache, the symbol and
the next position are looked up for all bit positions at once, and only the walk from pixel to pixel is left.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
# Fixed values of the format: order of code length codes, and the pixels near by that short distance codes name.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1),
    (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3),
    (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
STEPS = 3  # of the walk that are joined, as a power of two


#: Pixels up to which an image is read symbol by symbol.
SCALAR_BELOW = 128


class Bits:
    """Little-endian bits of some bytes, read in order."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(16), 0

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the image ends early")
        return value


@lru_cache(maxsize=16)
def _reversal(bits: int) -> np.ndarray:
    """The numbers below 2**bits with their bits in reverse."""
    found = np.zeros(1, np.int64)
    for _ in range(bits):
        found = np.concatenate([2 * found, 2 * found + 1])
    return found


class Code:
    """A prefix code: symbol and length for the next bits, or one symbol that takes no bits."""

    __slots__ = ("bits", "lengths", "only", "symbols")

    def __init__(self, lengths: np.ndarray | None, only: int = 0) -> None:
        self.bits, self.only = 0, only
        used = np.flatnonzero(lengths) if lengths is not None else ()
        if len(used) == 1:
            self.only = int(used[0])
        elif len(used):
            order = used[np.argsort(lengths[used], kind="stable")]
            size = lengths[order].astype(np.int64)
            self.bits = int(size[-1])
            many = 1 << (self.bits - size)
            if many.sum() != 1 << self.bits:
                raise ValueError("a prefix code isn't complete")
            back = _reversal(self.bits)
            self.symbols, self.lengths = np.repeat(order, many)[back], np.repeat(size, many)[back]

    def next(self, bits: Bits) -> int:
        if not self.bits:
            return self.only
        byte = bits.at >> 3
        k = (int.from_bytes(bits.data[byte : byte + 4], "little") >> (bits.at & 7)) & ((1 << self.bits) - 1)
        bits.at += int(self.lengths[k])
        return int(self.symbols[k])


def _read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        one = bits.read(8 if wide else 1)
        if not two:
            return Code(None, one)
        lengths = np.zeros(size, np.int64)
        lengths[[one, bits.read(8)]] = 1
        return Code(lengths)
    lengths = [0] * size
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(np.array(first))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        symbol = code.next(bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            before = symbol or before
        else:
            value, extra, least = {16: (before, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[symbol]
            many = least + bits.read(extra)
            lengths[at : at + many] = [value] * min(many, size - at)
            at += many
    return Code(np.array(lengths))


def _expand(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _entropy_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """ARGB pixels as uint32, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, meta = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        meta = (_entropy_image(bits, across, -(-height >> block)) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    size = 256 + 24 + ((1 << cache_bits) if cache_bits else 0)
    codes = [[_read_code(bits, n) for n in (size, 256, 256, 256, 40)] for _ in range(groups)]
    if meta is None and not cache_bits and width * height > SCALAR_BELOW:
        return _one_group(bits, codes[0], width, width * height)
    out = np.zeros(width * height, np.uint32)
    cache = [0] * (1 << cache_bits)
    at = 0

    def put(value: int) -> None:
        nonlocal at
        out[at] = value
        at += 1
        if cache_bits:
            cache[(value * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = value

    while at < len(out):
        group = codes[int(meta[(at // width >> block) * across + (at % width >> block)])] if meta is not None else codes[0]
        symbol = group[GREEN].next(bits)
        if symbol < 256:
            red, blue, alpha = (group[k].next(bits) for k in (RED, BLUE, ALPHA))
            put(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 280:
            many = _expand(bits, symbol - 256)
            back = _distance(_expand(bits, group[DISTANCE].next(bits)), width)
            if back > at:
                raise ValueError("a back-reference points before the image")
            for _ in range(min(many, len(out) - at)):
                put(int(out[at - back]))
        else:
            put(cache[symbol - 280])
    return out


def _one_group(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    out = np.zeros(total, np.uint32)
    first = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8)[first:]
    shift = np.arange(8, dtype=np.uint32)
    wide = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
    peek = ((wide[:, None] >> shift) & np.uint32(0x7FFF)).reshape(-1)
    last = len(peek) - 1

    def look(code: Code, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = peek[at] & np.uint32((1 << code.bits) - 1)
        return code.symbols[k], code.lengths[k]

    green = codes[GREEN]
    others = [codes[c] for c in (RED, BLUE, ALPHA)]
    if not green.bits and not any(c.bits for c in others) and green.only < 256:  # pixels that take no bits
        out[:] = others[2].only << 24 | others[0].only << 16 | green.only << 8 | others[1].only
        return out
    # a step of 0 makes the walk wait: a back-reference starts there
    if green.bits:
        follow = np.take(np.where(green.symbols < 256, green.lengths, 0), peek & np.uint32((1 << green.bits) - 1))
    else:
        follow = np.zeros(len(peek), np.int64)
    waits = follow == 0 if any(c.bits for c in others) else None
    follow += np.arange(len(peek))
    for code in others:
        if code.bits:
            follow = np.minimum(follow, last)
            follow = follow + np.take(code.lengths, peek[follow] & np.uint32((1 << code.bits) - 1))
    if waits is not None and green.bits:
        follow[waits] = np.flatnonzero(waits)
    follow = [np.minimum(follow, last, out=follow)]
    for _ in range(STEPS):
        follow.append(np.take(follow[-1], follow[-1], mode="clip"))
    at, place = 0, bits.at - 8 * first
    far = follow[STEPS]
    while at < total:
        anchors, p = [], place
        for _ in range(-(-(total - at) >> STEPS)):
            anchors.append(p)
            q = int(far[p])
            if q == p:
                break
            p = q
        way = np.array(anchors)
        for k in range(STEPS - 1, -1, -1):
            way = np.stack([way, follow[k][way]], axis=1).reshape(-1)
        way = way[: total - at]
        symbol, size = look(green, way) if green.bits else (np.full(len(way), green.only), 0)
        halts = np.flatnonzero(symbol >= 256)
        if len(halts):
            way, symbol, size = way[: halts[0]], symbol[: halts[0]], size[: halts[0]] if green.bits else 0
        if len(way):
            pixel, p = symbol.astype(np.uint32) << np.uint32(8), way + size
            for code, up in zip(others, (16, 0, 24), strict=True):
                if code.bits:
                    symbol, size = look(code, p)
                    pixel, p = pixel | symbol.astype(np.uint32) << np.uint32(up), p + size
                else:
                    pixel |= np.uint32(code.only << up)
            out[at : at + len(way)] = pixel
            at += len(way)
            place = int(p[-1])
        if at == total:
            break
        bits.at = place + 8 * first
        symbol = green.next(bits)
        if symbol < 256:
            raise ValueError("the image ends early")
        many = min(_expand(bits, symbol - 256), total - at)
        back = _distance(_expand(bits, codes[DISTANCE].next(bits)), width)
        if back > at:
            raise ValueError("a back-reference points before the image")
        out[at : at + many] = np.resize(out[at - back : at], many)
        at += many
        place = bits.at - 8 * first
    bits.at = place + 8 * first
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Modes 0 to 13 of the predictor for pixels whose neighbours are known; right is the one above to the right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return ((left + right) // 2 + top) // 2
    if mode == 6:
        return (left + corner) // 2
    if mode == 7:
        return (left + top) // 2
    if mode == 8:
        return (corner + top) // 2
    if mode == 9:
        return (top + right) // 2
    if mode == 10:
        return ((left + corner) // 2 + (top + right) // 2) // 2
    if mode == 11:
        return left if np.abs(top - corner).sum() < np.abs(left - corner).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = (left + top) // 2
        return np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.array([255, 0, 0, 0], np.int32)


FROM_ABOVE = frozenset((2, 3, 4, 8, 9))


def _undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    grid = _channels(pixels).reshape(-1, width, 4)
    grid[0, 0] = (grid[0, 0] + [255, 0, 0, 0]) & 255
    grid[0] = np.cumsum(grid[0], axis=0) & 255
    across = -(-width >> block)
    for y in range(1, len(grid)):
        row, above = grid[y], grid[y - 1]
        row[0] = (row[0] + above[0]) & 255
        right = np.concatenate([above[1:], row[:1]])
        for b in range(across):
            a, z = max(1, b << block), min(width, (b + 1) << block)
            mode = int(modes[(y >> block) * across + b])
            if a >= z:
                continue
            if mode in FROM_ABOVE:
                row[a:z] = (row[a:z] + _predicted(mode, row[a:z], above[a:z], right[a:z], above[a - 1 : z - 1])) & 255
            elif mode == 1:
                row[a:z] = np.cumsum(np.concatenate([row[a - 1 : a], row[a:z]]), axis=0)[1:] & 255
            elif mode in (0, 14, 15):
                row[a:z] = (row[a:z] + _predicted(0, row, row, row, row)) & 255
            else:
                for x in range(a, z):
                    row[x] = (row[x] + _predicted(mode, row[x - 1], above[x], right[x], above[x - 1])) & 255
    return _joined(grid).reshape(-1)


def _undo_cross_colour(pixels: np.ndarray, width: int, factors: np.ndarray, block: int) -> np.ndarray:
    c = _channels(pixels).reshape(-1, width, 4)
    y, x = np.arange(len(c)) >> block, np.arange(width) >> block
    factor = _channels(factors).reshape(-1, -(-width >> block), 4)[y][:, x].astype(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.int8).astype(np.int32)
    green = signed(c[..., 2])
    c[..., 1] = (c[..., 1] + (factor[..., 3] * green >> 5)) & 255
    c[..., 3] = (c[..., 3] + (factor[..., 2] * green >> 5)) & 255
    c[..., 3] = (c[..., 3] + (factor[..., 1] * signed(c[..., 1]) >> 5)) & 255
    return _joined(c).reshape(-1)


def _undo_green(pixels: np.ndarray) -> np.ndarray:
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    red, blue = (pixels >> np.uint32(16)) + green, pixels + green
    return pixels & np.uint32(0xFF00FF00) | (red & np.uint32(255)) << np.uint32(16) | blue & np.uint32(255)


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    pack = _pack_bits(len(palette))
    if pack:
        size = 8 >> pack
        index = index.reshape(-1, -(-width >> pack))[:, :, None] >> (size * np.arange(1 << pack))
        index = (index & ((1 << size) - 1)).reshape(len(index), -1)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(file: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file: uint8 array of height, width and the channels A, R, G, B."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or file[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[21 : 20 + struct.unpack("<I", file[16:20])[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo = []
    packed = width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            block = bits.read(3) + 2
            data = _entropy_image(bits, -(-packed >> block), -(-height >> block))
            undo.append((kind, packed, data if kind else (data >> np.uint32(8)) & np.uint32(15), block))
        elif kind == 2:
            undo.append((kind, packed, None, 0))
        else:
            size = bits.read(8) + 1
            table = np.cumsum(_channels(_entropy_image(bits, size, 1)), axis=0) & 255
            undo.append((kind, packed, _joined(table), 0))
            packed = -(-packed >> _pack_bits(size))
    pixels = _entropy_image(bits, packed, height, main=True)
    for kind, across, data, block in reversed(undo):
        if kind == 0:
            pixels = _undo_predictor(pixels, across, data, block)
        elif kind == 1:
            pixels = _undo_cross_colour(pixels, across, data, block)
        elif kind == 2:
            pixels = _undo_green(pixels)
        else:
            pixels = _undo_palette(pixels, across, data)
    return _channels(pixels).astype(np.uint8).reshape(height, width, 4)


class Out:
    """Bits written one value after the other, lowest first."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a complete prefix code, none above limit, near the best for the counts; one used symbol gets length 1."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = counts[used]
    while True:
        order = np.argsort(weight, kind="stable")
        leaves, inner = weight[order].tolist(), []
        n, i, j = len(leaves), 0, 0
        parent = [0] * (2 * n - 1)
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if j >= len(inner) or (i < n and leaves[i] <= inner[j]):
                    total += leaves[i]
                    parent[i] = n + k
                    i += 1
                else:
                    total += inner[j]
                    parent[n + j] = n + k
                    j += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            lengths[used[order]] = depth[:n]
            return lengths
        weight = weight // 2 + 1


def code_values(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code as they stand in the stream, lowest first."""
    used = np.flatnonzero(lengths)
    values = np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return values
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order]
    longest = int(size[-1])
    start = np.cumsum(1 << (longest - size)) - (1 << (longest - size))
    values[order] = _reversal(longest)[start]  # reversed at full length, the code's own bits come first
    return values


def write_only(out: Out, symbol: int) -> None:
    out.put(1 | 4, 3)  # simple, one symbol, of eight bits
    out.put(symbol, 8)


def write_code(out: Out, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        write_only(out, int(used[0]) if len(used) else 0)
        return
    tokens: list[tuple[int, int, int]] = []
    before = -1
    for at in [*used.tolist(), len(lengths)]:
        gap = at - before - 1
        while gap:
            if gap < 3:
                tokens.append((0, 0, 0))
                gap -= 1
            else:
                many = min(gap, 138 if gap > 10 else 10)
                tokens.append((18, many - 11, 7) if many > 10 else (17, many - 3, 3))
                gap -= many
        if at < len(lengths):
            tokens.append((int(lengths[at]), 0, 0))
        before = at
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    values = code_values(first).tolist()
    widths = first.tolist() if (first > 0).sum() > 1 else [0] * 19
    many = max([4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if first[s])])
    out.put(0, 1)
    out.put(many - 4, 4)
    for s in LENGTH_ORDER[:many]:
        out.put(int(first[s]), 3)
    out.put(0, 1)
    for symbol, extra, n in tokens:
        out.put(values[symbol], widths[symbol])
        out.put(extra, n)


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths and distance codes from 1."""
    v = np.asarray(value, np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.maximum(top - 1, 0)
    symbol = np.where(v < 4, v, 2 * top + ((v >> extra) & 1))
    extra = np.where(v < 4, 0, extra)
    return symbol, v & ((1 << extra) - 1), extra


def _pack_words(code: np.ndarray, size: np.ndarray, head: Out) -> bytes:
    """head's bits, then each code's size bits, as bytes."""
    if len(code) % 2:
        code, size = np.append(code, np.uint64(0)), np.append(size, 0)
    code = code[0::2] | code[1::2] << size[0::2].astype(np.uint64)
    size = size[0::2] + size[1::2]
    ends = np.cumsum(size) + head.size
    total = int(ends[-1]) if len(ends) else head.size
    words = np.zeros((total >> 6) + 2, np.uint64)
    start = ends - size
    word, up = start >> 6, (start & 63).astype(np.uint64)
    if len(word):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] |= np.bitwise_or.reduceat(code << up, first)
        words[word[first] + 1] |= np.bitwise_or.reduceat((code >> np.uint64(1)) >> (np.uint64(63) - up), first)
    body = words.tobytes()[: (total + 7) >> 3]
    n = (head.size + 7) >> 3
    front = int.from_bytes(body[:n], "little") | head.value
    return front.to_bytes(n, "little") + body[n:]


def _write_palette(head: Out, colours: np.ndarray) -> None:
    """Grey colours, each as the difference from the one before."""
    head.put(len(colours) - 1, 8)
    steps = np.diff(colours.astype(np.int64), prepend=0)
    counts = np.bincount(steps, minlength=280)
    lengths = code_lengths(counts, 15)
    values = code_values(lengths).tolist()
    widths = lengths.tolist() if np.count_nonzero(counts) > 1 else [0] * 280
    alpha = np.zeros(256, np.int64)
    alpha[255] = 1
    alpha[0] = len(colours) > 1
    head.put(0, 1)  # no colour cache
    for code in (lengths, lengths[:256], lengths[:256], alpha, np.zeros(40, np.int64)):
        write_code(head, code)
    for k, step in enumerate(steps.tolist()):
        for _ in range(3):
            head.put(values[step], widths[step])
        if len(colours) > 1:
            head.put(0 if k else 1, 1)


LEAST_RUN, MOST_RUN = 8, 4096


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of 8-bit samples as grey pixels, with back-references for runs.

    Up to 16 different samples become a palette whose indices share bytes; others subtract green from red and blue.
    """
    height = len(samples) // width
    head = Out()
    head.put(width - 1, 14)
    head.put(height - 1, 14)
    head.put(0, 4)
    head.put(1, 1)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(colours) > 16:
        head.put(2, 2)
        index = samples
    else:
        head.put(3, 2)
        _write_palette(head, colours)
        pack = _pack_bits(len(colours))
        grid = np.searchsorted(colours, samples).reshape(height, width)
        grid = np.pad(grid, ((0, 0), (0, -width % (1 << pack)))).reshape(height, -1, 1 << pack)
        index = (grid << ((8 >> pack) * np.arange(1 << pack))).sum(axis=2).reshape(-1)
    head.put(0, 1)  # no more transforms
    head.put(0, 2)  # no colour cache, one group of codes
    edge = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    run = np.diff(np.append(edge, len(index)))
    symbol, extra, more = index.astype(np.int64), None, None
    if (run >= LEAST_RUN).any():
        parts: list[np.ndarray] = []
        at = 0
        for k in np.flatnonzero(run >= LEAST_RUN).tolist():
            a, n = int(edge[k]), int(run[k]) - 1
            parts.append(index[at : a + 1])
            cuts = np.array([MOST_RUN] * (n // MOST_RUN) + ([n % MOST_RUN] if n % MOST_RUN else []), np.int64)
            parts.append(-cuts)
            at = a + 1 + n
        parts.append(index[at:])
        symbol = np.concatenate(parts)
        copy = symbol < 0
        s, x, n = prefix_of(np.where(copy, -symbol, 1))
        symbol = np.where(copy, 256 + s, symbol)
        extra, more = np.where(copy, x, 0).astype(np.uint64), np.where(copy, n, 0)
    lengths = code_lengths(np.bincount(symbol, minlength=280), 15)
    write_code(head, lengths)
    for only in (0, 0, 255, 1):  # red, blue, alpha, and distance code 2: the pixel to the left
        write_only(head, only)
    size = lengths[symbol] if np.count_nonzero(lengths) > 1 else np.zeros(len(symbol), np.int64)
    code = code_values(lengths)[symbol].astype(np.uint64)
    if extra is not None:
        code = code | extra << size.astype(np.uint64)
        size = size + more
    body = b"\x2f" + _pack_words(code, size, head)
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
