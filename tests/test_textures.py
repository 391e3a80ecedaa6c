"""PNG decoding, textures cut from pages, and image pyramids in steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import raster, textures
from quadrille.sources import png


@pytest.mark.parametrize("channels", [1, 3, 4])
@pytest.mark.parametrize("filters", [None, [0, 1, 2, 1, 2, 0], [0, 1, 2, 3, 4, 3], [4] * 6, [3] * 6])
def test_decode(channels, filters):
    image = np.random.default_rng(channels).integers(0, 256, (6, 9, channels)).astype(np.uint8)
    got = png.decode(raster.png(image[..., 0] if channels == 1 else image, filters))
    assert (got[..., :3] == image[..., :3]).all() and (got[..., 3] == (image[..., 3] if channels == 4 else 255)).all()


def _image(kind, raw, w, h, *extra):
    import struct
    import zlib

    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + b"".join(part(*e) for e in extra) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_palettes_and_clear_colours():
    palette = _image(3, b"\0\0\1\0\1\2", 2, 2, (b"PLTE", bytes(range(9))), (b"tRNS", b"\x80\x00"))
    assert png.decode(palette).tolist() == [[[0, 1, 2, 128], [3, 4, 5, 0]], [[3, 4, 5, 0], [6, 7, 8, 255]]]
    assert png.decode(_image(0, b"\0\7\11", 2, 1, (b"tRNS", b"\0\7"))).tolist() == [[[7, 7, 7, 0], [9, 9, 9, 255]]]
    assert png.decode(_image(4, b"\0\7\11", 1, 1)).tolist() == [[[7, 7, 7, 9]]]
    for bad in (b"", b"\x89PNG\r\n\x1a\n", _image(3, b"\0\5", 1, 1, (b"PLTE", bytes(3))), _image(0, b"\7\0", 1, 1), _image(0, b"\0", 1, 1)):
        with pytest.raises(ValueError):
            png.decode(bad)


def _page(spark, rows):
    return spark.createDataFrame(rows, "path string, page_no int, textures array<struct<name:string,x:int,y:int,w:int,h:int,ox:int,oy:int,ow:int,oh:int>>, png binary, error string")


def test_cut_and_library(spark):
    image = np.zeros((8, 8, 4), np.uint8)
    image[2:4, 3:6] = [10, 20, 30, 255]
    image[7, 7] = [1, 2, 3, 128]
    page = raster.png(image)
    rows = [
        ("p/a.pack", 0, [("t", 2, 1, 5, 4, 1, 2, 11, 20), ("clear", 0, 0, 2, 2, 0, 0, 2, 2), ("edge", 6, 6, 4, 4, 0, 0, 4, 4)], page, None),
        ("p/b.pack", 0, [("t", 7, 7, 1, 1, 0, 0, 1, 1)], page, None),
        ("p/b.pack", 1, [("u", 0, 0, 1, 1, 0, 0, 1, 1)], b"broken", None),
        ("p/other.pack", 0, [("t", 3, 2, 1, 1, 0, 0, 1, 1)], page, None),
    ]
    cut = textures.cut(_page(spark, rows)).cache()
    got = {(r.path, r.name): (r.ox, r.oy, r.w, r.h) for r in cut.filter("error is null").collect()}
    assert got["p/a.pack", "t"] == (1 - 5 + 1, 2 - 20 + 1, 3, 2) and got["p/a.pack", "clear"] == (0, 0, 0, 0)
    assert got["p/a.pack", "edge"] == (-2 + 1, -4 + 1, 1, 1)  # what lies beyond the page is transparent
    assert [r.page_no for r in cut.filter("error is not null").collect()] == [1]
    rank = textures.pack_rank(cut["path"], ("a.pack", "b.pack"))
    lib = textures.library(cut, rank)
    assert {r.name: (r.w, r.h) for r in lib.collect()} == {"t": (1, 1), "clear": (0, 0), "edge": (1, 1)}
    sums = {r.name: tuple(r)[1:] for r in textures.colour_sums(cut.filter("path = 'p/a.pack'")).collect()}
    assert sums == {"t": (60, 120, 180, 6), "clear": (0, 0, 0, 1), "edge": (0, 0, 0, 1)}
    pages = _page(spark, rows)
    at = {r.name: (r.page_id, r.x, r.ox, r.oy) for r in textures.atlas(pages, textures.pack_rank(pages["path"], ("b.pack", "a.pack"))).collect()}
    assert at == {"t": (2, 2, -4, -18), "clear": (2, 0, -1, -2), "edge": (2, 6, -2, -4), "u": (1, 0, 0, -1)}


@pytest.mark.parametrize("half", [raster.nearest_half, raster.box_half, raster.lanczos_half])
def test_pyramid_in_steps(spark, half):
    """Steps of one, two and all levels make the same tiles, those that one plain loop makes."""
    rng = np.random.default_rng(2)
    now = {(x, y): rng.integers(0, 256, (4, 4, 4)).astype(np.uint8) for x in range(-3, 4) for y in range(0, 5) if (x + y) % 4}
    tiles = spark.createDataFrame([(0, 0, x, y, 4, im.tobytes()) for (x, y), im in now.items()], raster.TILES)
    want = {(0, *k): im.tobytes() for k, im in now.items()}
    for level in range(1, 4):
        above = {}
        for tx, ty in {(x // 2, y // 2) for x, y in now}:
            whole = np.zeros((8, 8, 4), np.uint8)
            for dx in (0, 1):
                for dy in (0, 1):
                    if (2 * tx + dx, 2 * ty + dy) in now:
                        whole[dy * 4 : dy * 4 + 4, dx * 4 : dx * 4 + 4] = now[2 * tx + dx, 2 * ty + dy]
            above[tx, ty] = half(whole)
        now = above
        want |= {(level, *k): im.tobytes() for k, im in now.items()}
    for step, levels in ((1, 3), (2, None)):
        got = {(r.level, r.tx, r.ty): bytes(r.rgba) for r in raster.image_pyramid(tiles, levels, half, step).collect()}
        assert got == want


def test_box_half():
    image = np.array([[[10, 0, 0, 255], [20, 0, 0, 255]], [[0, 0, 0, 0], [0, 0, 0, 0]]], np.uint8)
    assert raster.box_half(image).tolist() == [[[15, 0, 0, 128]]]


def test_no_task_holds_many_packs(spark):
    from quadrille.plans.images import PACKS_EACH, _pack_files

    files = _pack_files(spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).count()
    assert files.agg(F.max("count")).first()[0] < 2 * PACKS_EACH


def test_pages_are_cut_once(spark):
    from quadrille.plans import images

    for query in (images.S10_A1_textures_of_pages, images.A1_A2_library_sums):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
