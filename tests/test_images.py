"""Image sizes from bytes, and the images of detail pages."""

from __future__ import annotations

import struct
import zlib

import pytest

from gleanery.operators import details
from gleanery.sources import images


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(w, h, kind=2, depth=8, *more):
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + b"".join(more) + chunk(b"IDAT", zlib.compress(b"\0" * 50)) + chunk(b"IEND", b"")


def gif(w, h, table=0):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80 | table if table else 0, 0, 0) + b"\0" * (3 << (1 + table) if table else 0) + b";"


def segment(mark, body):
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


def jpeg(w, h, frame=0xC0, before=b"", parts=3):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + b"\0" * 9) + before + segment(frame, struct.pack(">BHHB", 8, h, w, parts) + b"\1\x22\0" * parts) + segment(0xDA, b"\0" * 10) + b"\xff\xd9"


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


THUMB = segment(0xE1, b"Exif" + jpeg(1, 1))
CASES = [
    (png(640, 480), (640, 480)), (png(1, 2_000_000), (1, 2_000_000)), (png(9, 8, 3, 4, chunk(b"gAMA", b"1234"), chunk(b"PLTE", b"123")), (9, 8)), (png(9, 8, 3), None), (png(9, 8, 5), None), (png(9, 8, 2, 4), None), (png(0, 8), None),
    (png(640, 480)[:32], None), (png(640, 480)[:33], (640, 480)), (png(640, 480).replace(b"IHDR", b"IHDr"), None), (images.PNG, None), (png(640, 480)[:20] + b"\1" + png(640, 480)[21:], None),
    (gif(300, 299), (300, 299)), (gif(7, 9, 3), (7, 9)), (gif(7, 9, 3)[:20], None), (b"GIF87a" + gif(5, 6)[6:], (5, 6)), (gif(5, 6)[:12], None), (b"GIF88a" + gif(5, 6)[6:], None),
    (jpeg(640, 481), (640, 481)), (jpeg(3, 4, 0xC2, THUMB + segment(0xFE, b"x" * 500)), (3, 4)), (jpeg(3, 4, 0xC1, b"\xff\xff\xff" + segment(0xDB, b"q" * 65)[1:]), (3, 4)), (jpeg(3, 4, before=b"stray\xff\0"), (3, 4)), (jpeg(3, 4, before=b"\xff\xd0"), (3, 4)),
    (jpeg(3, 4, 0xC3), None), (jpeg(3, 4, 0xC9), None), (jpeg(3, 4, parts=2), None), (jpeg(640, 480)[:25], None), (b"\xff\xd8\xff\xd9", None), (b"\xff\xd8" + segment(0xDA, b"\0" * 6), None), (b"\xff\xd8\xff\xe0\0\1", None),
    (jpeg(3, 4, before=segment(0xE2, b"p" * 65_000)), (3, 4)), (jpeg(3, 4, before=segment(0xE2, b"p" * 65_000) * 2), None),
    (webp(b"VP8X", b"\0" * 4 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little")), (800, 600)), (webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")), (100, 50)), (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 33, 44)), (33, 44)), (webp(b"VP8X", b""), None),
    (b"", None), (None, None), (b"<svg width='9'>", None), (b"BM" + b"\0" * 60, None),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_image_size(case):
    data, want = CASES[case]
    assert images.image_size(data) == want


def test_every_cut_of_a_head_has_no_size():
    for whole, least in ((png(640, 480), 33), (gif(7, 9, 3), 13 + 48), (jpeg(640, 480), 39)):
        assert [images.image_size(whole[:n]) is not None for n in range(len(whole))] == [n >= least for n in range(len(whole))]


def test_sizes_of_files_and_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(10, 20))
    (tmp_path / "y.webp").write_bytes(webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little")))
    (tmp_path / "z.jpg").write_bytes(b"cut")
    found = images.read_images(spark, f"file://{tmp_path}")
    assert [(r.url[-5:], r.w, r.h) for r in images.sizes(found).collect()] == [("x.png", 10, 20)]
    assert sorted((r.w, r.h) for r in images.sizes(found, ("png", "webp")).collect()) == [(10, 20), (100, 50)]
    df = spark.createDataFrame([("u", bytearray(gif(5, 6))), ("u", bytearray(gif(5, 9))), ("v", None), (None, bytearray(gif(5, 6)))], "url string, content binary")
    assert [tuple(r) for r in images.sizes(df).collect()] == [("u", 5, 9)]


def test_detail_images_by_size(spark):
    page = "<img class=g src=/a.png><img class=g src=/b.png width=400 height=400><img class=g src=/c.png width=100><img class=g src=/d.png><img class=g src=/e.png width=auto data-width=299><img class=g src=/b.png><img class=g src=/f.png width=400>"
    pages = spark.createDataFrame([("https://a.test/v/1", page), ("https://a.test/v/2", "<p>none</p>"), ("https://a.test/v/3", "<img class=g src=/a.png>")], "url string, html string")
    sizes = spark.createDataFrame([("https://a.test/a.png", 299, 900), ("https://a.test/b.png", 1, 1), ("https://a.test/d.png", 300, 300), ("https://a.test/f.png", 2, 2)], "url string, w long, h long")
    parsed = details.parse_details(pages, {"imageSelector": ".g"})
    assert {r.url[-1]: (r.images, r.large) for r in parsed.collect()} == {"1": (["/a.png", "/b.png", "/d.png", "/f.png"], ["/b.png"]), "2": ([], []), "3": (["/a.png"], [])}
    assert {r.url[-1]: r.images for r in details.without_small_images(parsed, sizes).collect()} == {"1": ["/b.png", "/d.png"], "2": [], "3": []}
