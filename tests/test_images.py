"""Compositing against one canvas, files that can't be read, and what is written beside tiles."""

import numpy as np
from pyspark.sql import functions as F

from quadrille.operators import raster
from quadrille.plans.jobs import JOBS
from quadrille.sources import text


def pictures(rng, n):
    out = {}
    for i in range(n):
        w, h = rng.integers(1, 9, 2)
        out[f"t{i}"] = (int(rng.integers(-4, 4)), int(rng.integers(-4, 4)), rng.integers(0, 256, (h, w, 4)).astype(np.uint8))
    return out


def table(spark, known):
    rows = [(n, ox, oy, im.shape[1], im.shape[0], im.tobytes()) for n, (ox, oy, im) in known.items()]
    return spark.createDataFrame(rows, raster.TEXTURES)


def test_half_transparent_draws(spark):
    """Tiles hold what drawing all textures on one canvas gives, over tile borders and at negative places too."""
    rng = np.random.default_rng(3)
    known = pictures(rng, 6)
    draws = [(0, int(x), int(y), i, f"t{i % 8}") for i, (x, y) in enumerate(rng.integers(-20, 20, (120, 2)))]  # t6 and t7 have no texture
    canvas, middle = np.zeros((80, 80, 4), np.uint8), 40
    for _, x, y, _, name in draws:
        if name in known:
            ox, oy, im = known[name]
            place = canvas[middle + y + oy : middle + y + oy + im.shape[0], middle + x + ox : middle + x + ox + im.shape[1]]
            place[:] = raster.over(place, im)
    tiles = raster.compose(spark.createDataFrame(draws, "layer long, px long, py long, ord long, name string"), table(spark, known), 8).cache()
    got = np.zeros_like(canvas)
    for t in tiles.collect():
        y, x = middle + t.ty * 8, middle + t.tx * 8
        got[y : y + 8, x : x + 8] = np.frombuffer(t.rgba, np.uint8).reshape(8, 8, 4)
    assert (got == canvas).all()
    ys, xs = np.nonzero(canvas[..., 3])
    want = {(x - middle, y - middle, canvas[y, x].tobytes().hex()) for y, x in zip(ys.tolist(), xs.tolist(), strict=True)}
    assert {(r.x, r.y, r.colour) for r in raster.pixels(tiles).collect()} == want


def test_base_has_levels(spark):
    squares = spark.createDataFrame([(0, x, y, 0, "a") for x in range(8) for y in range(8)] + [(0, 0, 0, 1, "missing")], "layer long, sx long, sy long, pos long, tile string")
    solid = spark.createDataFrame([("a", -2, -4, 4, 4, b"\x10\x20\x30\xff" * 16)], raster.TEXTURES)
    tiles = JOBS["base"](squares, solid, 8, (2, 1), levels=2).collect()
    assert {t.level for t in tiles} == {0, 1, 2} and len({(t.level, t.tx, t.ty) for t in tiles}) == len(tiles)
    parents = {(t.level + 1, t.tx // 2, t.ty // 2) for t in tiles if t.level < 2}
    assert parents == {(t.level, t.tx, t.ty) for t in tiles if t.level}


def test_trimming_moves_offsets(spark):
    im = np.zeros((5, 6, 4), np.uint8)
    im[2:4, 1:3] = 9
    rows = {r.name: r for r in raster.trimmed(table(spark, {"a": (10, 20, im), "clear": (1, 1, im * 0), "full": (1, 2, im[2:4, 1:3])})).collect()}
    assert tuple(rows["a"])[1:5] == (11, 22, 2, 2) and rows["a"].rgba == b"\x09" * 16
    assert tuple(rows["clear"])[1:5] == (0, 0, 0, 0) and tuple(rows["full"])[1:5] == (1, 2, 2, 2)


def test_written_textures_and_descriptions(spark, tmp_path):
    im = np.full((2, 3, 4), 7, np.uint8)
    raster.write_textures(table(spark, {"a": (1, 2, im), "clear": (0, 0, im * 0)}), str(tmp_path / "t"))
    rows = {r.name: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert text.grey_pixels(bytes(rows["a"].png)) == (3, 2, b"\x07" * 6) and rows["clear"].png is None and rows["a"].digest != rows["clear"].digest
    d = raster.skeleton(spark.createDataFrame([(-1,), (0,), (0,)], "layer long"), 5, 1, 64, skip=1)
    raster.write_skeleton(d, str(tmp_path / "d"))
    found = spark.read.text(str(tmp_path / "d")).select("file", F.col("value").contains('Width="3" Height="1"').alias("ok")).collect()
    assert sorted(map(tuple, found)) == [("layer-1.dzi", True), ("layer0.dzi", True)]


def test_crops_of_upper_levels(spark):
    tile = np.zeros((4, 4, 4), np.uint8)
    tile[3, 3] = 255
    rows = [(0, 0, 0, 0, 4, tile.tobytes()), (0, 0, 1, 0, 4, tile.tobytes()), (0, 1, 0, 0, 4, tile.tobytes())]
    got = {(r.level, r.tx): (r.w, r.h, r.state) for r in raster.cropped(spark.createDataFrame(rows, raster.TILES), 7, 4).collect()}
    assert got == {(0, 0): (4, 4, "saved"), (0, 1): (3, 4, "empty"), (1, 0): (4, 2, "empty")}


def test_files_that_cannot_be_read(spark):
    good = "objects = { { type = 'A', x = 1 } }"
    rows = [("/a.lua", good.encode()), ("/b.lua", b"objects = { run() }"), ("/c.lua", b"nothing = {}"), ("/d.lua", b"objects = {}")]
    z = {r.path: r for r in text.zones(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert z["/a.lua"].type == "A" and z["/a.lua"].error is None
    assert z["/b.lua"].error and z["/c.lua"].error and z["/b.lua"].ord is None and "/d.lua" not in z
    images = [("/biomemap_1_2.png", b"no image"), ("/biomemap_3_4.png", raster.png(np.full((1, 2), 5, np.uint8))), ("/other.png", b"")]
    p = text.rasters(spark.createDataFrame(images, "path string, content binary")).collect()
    assert {(r.cx, r.cy, r.x, r.y, r.pixel, r.error is None) for r in p} == {(1, 2, None, None, None, False), (3, 4, 0, 0, 5, True), (3, 4, 1, 0, 5, True)}


def test_mark_arrays(spark):
    m = spark.createDataFrame([(0, 2, "b", None), (0, 1, "a", 3), (1, 5, "", 0)], "cell long, id long, name string, w long")
    got = {r.cell: r.json for r in raster.mark_array(m, ["cell"]).collect()}
    assert got == {0: '[\n{"id":1,"name":"a","w":3},\n{"id":2,"name":"b"}\n]', 1: '[\n{"id":5,"name":"","w":0}\n]'}


def test_equal_json(spark):
    from quadrille.functions.values import same_json

    rows = [('{"a":1,"b":[2]}', ' {"b": [2], "a": 1}', True), ("1", "2", False), ("null", "null", True), ("1}", "1", None), ("1,2", "1", None), ("1][2", "1", None), ("", "1", None), (None, "1", None), ('1,"b":2', "1", None)]
    got = spark.createDataFrame(rows, "a string, b string, want boolean").select("a", same_json("a", "b").alias("got"), "want").collect()
    assert [r for r in got if r.got is not r.want] == []
