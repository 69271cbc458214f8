"""Scalar expressions of the audit and scoring stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeflow.functions.vectors import let

# File name extensions of images, and those that prediction takes.
IMAGE_EXTENSIONS = (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
PREDICT_EXTENSIONS = (".bmp", ".jpeg", ".jpg", ".png", ".webp")


def extension(path: Column) -> Column:
    """Lower-cased file extension with its dot, empty if none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def has_extension(path: Column, allowed: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    return extension(path).isin(*allowed)


def aspect_ratio(width: Column, height: Column) -> Column:
    """width / height to six places; null where height is 0."""
    return F.when(height != 0, F.round(width / height, 6))


def crc32_hex(data: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(data))), 8, "0")


def digest(data: Column, algorithm: str = "sha256") -> Column:
    """Hex digest by md5, sha1 or sha256."""
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256)}[algorithm](data)


def path_parts(path: Column) -> Column:
    """Parts of a path with / or \\ between them; empty and '.' parts carry nothing."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))


def is_safe_path(path: Column) -> Column:
    """Not empty, relative, no drive letter in front, and no '..' part."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    drive = F.coalesce(F.contains(F.split_part(plain, F.lit("/"), F.lit(1)), F.lit(":")), F.lit(False))
    return F.coalesce((plain != "") & ~F.startswith(plain, F.lit("/")) & ~drive & ~F.array_contains(F.split(plain, "/"), ".."), F.lit(False))


def safe_path(path: Column) -> Column:
    """The collapsed path, null where it is not safe."""
    return F.when(is_safe_path(path), F.array_join(path_parts(path), "/"))


def hex_to_long(h: Column) -> Column:
    """64 bits from 16 hex digits as two's complement; null for other input."""
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")
    return F.when(F.rlike(h, F.lit("^[0-9a-fA-F]{16}$")), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


SEGMENTS = ((0, 21), (21, 21), (42, 22))


def segment(h: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << width) - 1))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def shrinkage(n: Column, tau: float = 10.0) -> Column:
    return n / (n + F.lit(tau))


def negative_log(p: Column) -> Column:
    return -F.ln(p + F.lit(1e-8))


def class_name(c: Column) -> Column:
    return F.printf(F.lit("%04d"), c)


def replace_prefix(path: Column, old: str, new: str) -> Column:
    """Every occurrence of old is replaced, not only the leading one, as in the original tool."""
    return F.replace(path, F.lit(old), F.lit(new))


def seeded_bucket(key: Column, seed: int, buckets: int) -> Column:
    """A bucket from 0 for each key, the same on every run and engine."""
    half = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(half, F.lit(buckets)).cast("int")


def seeded_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key."""
    half = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double")
    return half / F.lit(4294967296.0)


def text_bar(share: Column, width: int = 20) -> Column:
    full = F.floor(clip(share, 0.0, 1.0) * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def duration(seconds: Column) -> Column:
    """h:mm:ss."""
    s = seconds.cast("bigint")
    return F.printf(F.lit("%d:%02d:%02d"), F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def block_bar(share: Column, width: int = 30) -> Column:
    """Full and light blocks, the full ones rounded half to even."""
    full = F.bround(clip(share, 0.0, 1.0) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def clock(seconds: Column) -> Column:
    """mm:ss below an hour, h:mm:ss from there; nothing is below 0."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(h > 0, F.printf(F.lit("%d:%02d:%02d"), h, m, F.pmod(s, F.lit(60)))).otherwise(F.printf(F.lit("%02d:%02d"), m, F.pmod(s, F.lit(60))))


def image_kind(content: Column) -> Column:
    """jpeg, png, gif, bmp or webp by a file's first bytes, if it also ends as such a file must; null otherwise."""
    head, size = F.hex(F.substring(content, 1, 12)), F.octet_length(content)
    tail = lambda n: F.hex(F.substring(content, -n, n))
    little = lambda text, at: F.conv(F.concat(*(F.substring(text, at + 2 * i, 2) for i in (3, 2, 1, 0))), 16, 10).cast("bigint")
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")) & (tail(2) == "FFD9"), "jpeg")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")) & (tail(8) == "49454E44AE426082"), "png")
        .when((F.startswith(head, F.lit("474946383761")) | F.startswith(head, F.lit("474946383961"))) & (tail(1) == "3B"), "gif")
        .when(F.startswith(head, F.lit("424D")) & (little(head, 5) == size), "bmp")
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")) & (little(head, 9) + 8 <= size), "webp")
    )


#: Segments of a JPEG among which its frame header is looked for.
JPEG_SEGMENTS = 1024


def _number(content: Column, at: Column | int, n: int, big: bool = True) -> Column:
    """The unsigned number in n bytes from byte at (counted from 0), null where they are not all there."""
    at = F.lit(at) if isinstance(at, int) else at
    data = F.hex(F.substring(content, at + 1, F.lit(n)))
    data = data if big else F.concat(*(F.substring(data, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.when(F.length(data) == 2 * n, F.conv(data, 16, 10).cast("bigint"))


def _jpeg_frame(content: Column) -> Column:
    """Where a JPEG's frame header begins: segments are followed by their lengths up to it; null if none comes before the scan."""

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        mark = _number(content, at, 2)
        low = mark.bitwiseAND(0xFF)
        frame = low.between(0xC0, 0xCF) & ~low.isin(0xC4, 0xC8, 0xCC)
        after = F.when(low == 0xFF, at + 1).when((low == 0x01) | low.between(0xD0, 0xD7), at + 2).when(low.isin(0xD9, 0xDA), F.lit(-1)).otherwise(at + 2 + _number(content, at + 2, 2))
        after = F.coalesce(F.when(mark >= 0xFF00, after), F.lit(-1)).cast("bigint")
        found = (mark >= 0xFF00) & frame
        moved = F.struct(F.when(found, F.lit(-1)).otherwise(after).cast("bigint").alias("at"), F.when(found, at).cast("bigint").alias("frame"))
        return F.when(at < 0, state).otherwise(moved)

    start = F.struct(F.lit(2).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("frame"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), start, step, lambda state: state["frame"])


def image_header(content: Column) -> Column:
    """struct(kind, width, height, aspect_ratio, mode) of an image's bytes, as its headers state them; nothing is decoded.

    kind is image_kind; without one all is null, as is each value that the header lacks. mode is 1, L, LA, P, RGB, RGBA, CMYK or I;16.
    A JPEG whose frame header does not come within JPEG_SEGMENTS segments has no sizes.
    """
    # each part is bound before the next reads it, so that a JPEG's segments are walked once
    placed = lambda c, k: F.struct(c.alias("content"), k.alias("kind"), F.when(k == "jpeg", _jpeg_frame(c)).alias("frame"))
    return let(content, lambda c: let(let(image_kind(c), lambda k: placed(c, k)), _sized))


def _sized(file: Column) -> Column:
    """image_header of struct(content, kind, frame)."""
    content, kind, frame = file["content"], file["kind"], file["frame"]
    chunk = F.hex(F.substring(content, 13, 4))
    packed = _number(content, 21, 4, big=False)  # of a lossless WebP: 14 bits a side, less one, and a bit for alpha
    part = lambda at: _number(content, at, 2, big=False).bitwiseAND(0x3FFF)
    signed = _number(content, 22, 4, big=False)
    lossy, lossless, extended = (chunk == x for x in ("56503820", "5650384C", "56503858"))

    def webp(plain: Column, low: Column, canvas: Column) -> Column:
        return F.when(lossy, plain).when(lossless & (_number(content, 20, 1) == 0x2F), low).when(extended, canvas)

    width = (
        F.when(kind == "png", _number(content, 16, 4))
        .when(kind == "gif", _number(content, 6, 2, big=False))
        .when(kind == "bmp", _number(content, 18, 4, big=False))
        .when(kind == "jpeg", _number(content, frame + 7, 2))
        .when(kind == "webp", webp(part(26), packed.bitwiseAND(0x3FFF) + 1, _number(content, 24, 3, big=False) + 1))
    )
    height = (
        F.when(kind == "png", _number(content, 20, 4))
        .when(kind == "gif", _number(content, 8, 2, big=False))
        .when(kind == "bmp", F.when(signed >= 1 << 31, F.lit(1 << 32) - signed).otherwise(signed))
        .when(kind == "jpeg", _number(content, frame + 5, 2))
        .when(kind == "webp", webp(part(28), F.shiftright(packed, 14).bitwiseAND(0x3FFF) + 1, _number(content, 27, 3, big=False) + 1))
    )
    depth, colour, bits, parts = _number(content, 24, 1), _number(content, 25, 1), _number(content, 28, 2, big=False), _number(content, frame + 9, 1)
    grey = F.when(depth == 1, "1").when(depth == 16, "I;16").otherwise("L")
    clear = webp(F.lit(False), F.shiftright(packed, 28).bitwiseAND(1) == 1, _number(content, 20, 1).bitwiseAND(0x10) > 0)
    mode = (
        F.when(kind == "png", F.when(colour == 0, grey).when(colour == 2, "RGB").when(colour == 3, "P").when(colour == 4, "LA").when(colour == 6, "RGBA"))
        .when(kind == "gif", "P")
        .when(kind == "bmp", F.when(bits == 1, "1").when(bits <= 8, "P").when(bits.isin(16, 24, 32), "RGB"))
        .when(kind == "jpeg", F.when(parts == 1, "L").when(parts == 3, "RGB").when(parts == 4, "CMYK"))
        .when(kind == "webp", F.when(clear, "RGBA").when(~clear, "RGB"))
    )
    sides = F.struct(width.alias("w"), height.alias("h"), mode.alias("mode"))
    stated = lambda x: F.struct(kind.alias("kind"), x["w"].alias("width"), x["h"].alias("height"), aspect_ratio(x["w"], x["h"]).alias("aspect_ratio"), x["mode"].alias("mode"))
    return let(sides, stated)


def layers(spec: str | int | list[int] | None, count: int) -> list[int]:
    """Layer indices for None (none), 'all', 'last_n', a number of last layers, or a list."""
    if spec is None:
        return []
    if isinstance(spec, list):
        return sorted({i % count for i in spec if -count <= i < count})
    n = count if spec == "all" else int(str(spec).removeprefix("last_"))
    return list(range(max(0, count - n), count))
