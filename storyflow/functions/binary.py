"""Hashes, image boxes and file kinds."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from storyflow.functions.udf import lazy

#: Fixed value: the name space of generated image names.
IMAGES = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

#: Media types by file extension.
MEDIA_TYPES = {"gif": "image/gif", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml"}


def uuid5(text: Column, space: str = IMAGES) -> Column:
    """RFC 4122 version 5 name of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(space.replace("-", ""))), F.encode(text, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    parts = [F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12)]
    return F.concat(*parts)


def inline_image_name(url: Column) -> Column:
    """A name for a ``data:`` image, by the MD5 of its bytes; other urls stay."""
    name = F.concat(F.lit("file:///"), F.md5(F.unbase64(F.split_part(url, F.lit(","), F.lit(2)))), F.lit("."), F.regexp_extract(url, r"^data:image/(\w+)", 1))
    return F.when(url.startswith("data:image/"), name).otherwise(url)


def fitted(width: Column, height: Column, most_wide: int, most_high: int) -> tuple[Column, Column, Column]:
    """(scaled, width, height) of a box shrunk, with its proportions, into another."""
    tall = height > most_high
    w1 = F.when(tall, F.floor(most_high / height * width)).otherwise(width)
    h1 = F.when(tall, F.lit(most_high)).otherwise(height)
    wide = w1 > most_wide
    w2 = F.when(wide, F.lit(most_wide)).otherwise(w1)
    h2 = F.when(wide, F.floor(most_wide / w1 * h1)).otherwise(h1)
    high = h2 > most_high
    w3 = F.when(high, F.floor(most_high / h2 * w2)).otherwise(w2)
    h3 = F.when(high, F.lit(most_high)).otherwise(h2)
    return tall | (width > most_wide), w3.cast("bigint"), h3.cast("bigint")


def media_type(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    return F.element_at(known, F.lower(F.regexp_extract(name, r"\.(\w+)(?:[?#].*)?$", 1)))


def sniffed_type(data: Column) -> Column:
    """Media type by the first bytes, null if unknown."""
    head = F.hex(F.substring(data, 1, 12))
    kinds = (("^FFD8FF", "image/jpeg"), ("^89504E470D0A1A0A", "image/png"), ("^474946383[79]61", "image/gif"), ("^52494646.{8}57454250", "image/webp"), ("^424D", "image/bmp"))
    out = F.lit(None).cast("string")
    for pattern, kind in kinds:
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    return out


def _binary(fn, kind: str, arrow: pa.DataType):
    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else fn(x) for x in batch.to_pylist()], arrow)

    mapped.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return lazy(mapped, kind)


def unpacked(encoding: str):
    """Column function: bytes without ``gzip`` or ``deflate``; '' leaves them. Damaged bodies give null."""
    if encoding not in ("", "gzip", "deflate"):
        raise ValueError(f"unsupported encoding {encoding}")

    def gunzip(data: bytes) -> bytes | None:
        try:
            return gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            return None

    def inflate(data: bytes) -> bytes | None:
        for bits in (15, -15):
            try:
                return zlib.decompress(data, bits)
            except zlib.error:
                pass
        return None

    return {"": lambda c: c, "gzip": _binary(gunzip, "binary", pa.binary()), "deflate": _binary(inflate, "binary", pa.binary())}[encoding]


def _fast_hash(data: bytes) -> int:
    """The 32-bit hash of Paul Hsieh, over little-endian pairs of 16 bits, as signed."""
    mask, h = 0xFFFFFFFF, len(data)
    if not data:
        return 0
    signed = lambda b: b - 256 if b > 127 else b
    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        low, high = int.from_bytes(data[at : at + 2], "little"), int.from_bytes(data[at + 2 : at + 4], "little")
        h = (h + low) & mask
        h = (h << 16 & mask) ^ (high << 11 & mask) ^ h
        h = (h + (h >> 11)) & mask
    rest = data[whole:]
    if len(rest) == 3:
        h = (h + int.from_bytes(rest[:2], "little")) & mask
        h ^= h << 16 & mask
        h ^= signed(rest[2]) << 18 & mask
        h = (h + (h >> 11)) & mask
    elif len(rest) == 2:
        h = (h + int.from_bytes(rest, "little")) & mask
        h ^= h << 11 & mask
        h = (h + (h >> 17)) & mask
    elif rest:
        h = (h + signed(rest[0])) & mask
        h ^= h << 10 & mask
        h = (h + (h >> 1)) & mask
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h ^= h << left & mask
        h = (h + (h >> right)) & mask
    return h - (1 << 32) if h >> 31 else h


fast_hash = _binary(_fast_hash, "int", pa.int32())


def series_index(text: Column) -> tuple[Column, Column]:
    """Name and index of ``Name [2.5]``; the index with two decimals, null without one."""
    index = F.regexp_extract(text, r"\[([0-9.]+)\]$", 1)
    return F.trim(F.regexp_replace(text, r"\[[0-9.]+\]$", "")), F.when(index != "", F.format_string("%.2f", index.cast("double")))


def series(name: Column, number: Column) -> Column:
    """``Name [2]``: whole numbers without decimals."""
    shown = F.when(number == F.floor(number), F.floor(number).cast("bigint").cast("string")).otherwise(number.cast("string"))
    return F.when(number.isNull(), name).otherwise(F.concat(name, F.lit(" ["), shown, F.lit("]")))


def simple_cache_name(key: Column) -> Column:
    """The name that the simple cache gives a key's file: eight bytes of its SHA-1, the last first, in hex."""
    digest = F.sha1(key.cast("binary"))
    return F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.substring(digest, i * 2 + 1, F.lit(2))), "")


def firefox_cache_name(key: Column) -> Column:
    """The same for the second Firefox cache: the SHA-1 in capitals."""
    return F.upper(F.sha1(key.cast("binary")))
