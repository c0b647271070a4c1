"""Sizes of landed images, decoded from their first 64 KiB in Arrow batches.

Only the head of an image leaves the JVM. Cut, damaged and unknown files have no size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD_BYTES = 64 * 1024
#: Formats whose sizes decide over images; sizes of others can be asked for.
FORMATS = ("png", "gif", "jpeg")

# Fixed values of the formats: signatures, bit depths by PNG colour type, JPEG frames that have a baseline or progressive size.
PNG, GIF, JPEG = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a"), b"\xff\xd8"
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
JPEG_FRAMES, JPEG_OTHER_FRAMES, JPEG_END, JPEG_SCAN = (0xC0, 0xC1, 0xC2), (0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF), 0xD9, 0xDA


def _png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Whole chunks with right checksums, up to the first that is not."""
    at = len(PNG)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4])
        body = data[at + 4 : at + 8 + size]
        check = data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(body) != int.from_bytes(check):
            return
        yield body[:4], body[4:]
        at += 12 + size


def _png(data: bytes) -> tuple[int, int] | None:
    chunks = _png_chunks(data)
    name, head = next(chunks, (b"", b""))
    if name != b"IHDR" or len(head) != 13:
        return None
    w, h = int.from_bytes(head[:4]), int.from_bytes(head[4:8])
    depth, kind, packing, filtering, interlace = head[8:]
    if not (0 < w < 1 << 31 and 0 < h < 1 << 31 and depth in PNG_DEPTHS.get(kind, ()) and packing == filtering == 0 and interlace < 2):
        return None
    if kind == 3:  # a palette must come before the pixels
        for name, _ in chunks:
            if name == b"PLTE":
                return w, h
            if name in (b"IDAT", b"IEND"):
                break
        return None
    return w, h


def _gif(data: bytes) -> tuple[int, int] | None:
    if len(data) < 13:
        return None
    colours = 3 << (1 + (data[10] & 7)) if data[10] & 0x80 else 0
    return (int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")) if len(data) >= 13 + colours else None


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF or data[at + 1] in (0x00, 0xFF):  # stray and fill bytes
            at += 2 if data[at] == 0xFF and data[at + 1] == 0x00 else 1
            continue
        mark = data[at + 1]
        at += 2
        if mark == JPEG_END or mark == JPEG_SCAN or mark in JPEG_OTHER_FRAMES:
            return None
        if 0xD0 <= mark <= 0xD7:
            continue
        size = int.from_bytes(data[at : at + 2])
        if size < 2 or at + size > len(data):
            return None
        if mark in JPEG_FRAMES:
            part = data[at + 2 : at + size]
            good = len(part) >= 6 and part[0] == 8 and part[5] in (1, 3, 4) and len(part) == 6 + 3 * part[5]
            return (int.from_bytes(part[3:5]), int.from_bytes(part[1:3])) if good else None
        at += size
    return None


def _webp(data: bytes) -> tuple[int, int] | None:
    kind, body, little = data[12:16], data[20:], lambda b: int.from_bytes(b, "little")
    if kind == b"VP8X" and len(body) >= 10:
        return little(body[4:7]) + 1, little(body[7:10]) + 1
    if kind == b"VP8L" and len(body) >= 5 and body[0] == 0x2F:
        bits = little(body[1:5])
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(body) >= 10 and body[3:6] == b"\x9d\x01\x2a":
        return little(body[6:8]) & 0x3FFF, little(body[8:10]) & 0x3FFF
    return None


def format_of(data: bytes) -> str | None:
    if data.startswith(PNG):
        return "png"
    if data.startswith(GIF):
        return "gif"
    if data.startswith(JPEG):
        return "jpeg"
    return "webp" if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height that an image's first bytes state, by its signature; None where they do not."""
    head = bytes((data or b"")[:HEAD_BYTES])
    kind = format_of(head)
    return {"png": _png, "gif": _gif, "jpeg": _jpeg, "webp": _webp}[kind](head) if kind else None


def _sizes(formats: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [image_size(d) if format_of(bytes(d)[:16]) in formats else None for d in rows["head"]]
            known = [f is not None for f in found]
            yield pd.DataFrame({"url": rows["url"][known], "w": [f[0] for f in found if f], "h": [f[1] for f in found if f]})

    return run


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``url, content`` of the files below a folder, the url being the file's path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("url"), "content")


def sizes(images: DataFrame, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """``url, w, h`` of the images (url, content) whose size can be told; a URL that was landed more than once counts by the
    larger of its sizes."""
    heads = images.where("url is not null and content is not null").select("url", F.substring("content", 1, HEAD_BYTES).alias("head"))
    return heads.mapInPandas(_sizes(formats), "url string, w long, h long").groupBy("url").agg(F.max(F.struct("w", "h")).alias("s")).select("url", "s.w", "s.h")
