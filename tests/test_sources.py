"""Binary and text sources, read back from files made here; images; streams; layouts."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import incremental, marks, raster
from quadrille.plans.jobs import JOBS
from quadrille.sources import binary, text
from quadrille.streaming import sources as streaming


def header_bytes(version, tiles, layers, rooms, buildings, side, zpop):
    out = (b"LOTH" if version else b"") + struct.pack("<II", version, len(tiles)) + b"".join(t.encode() + b"\n" for t in tiles)
    out += (b"" if version else b"\0") + struct.pack("<II", 1, 2)
    out += struct.pack("<ii", layers[0], layers[1] - 1) if version else struct.pack("<i", layers[1])
    out += struct.pack("<I", len(rooms))
    for name, layer, rects, objects in rooms:
        out += name + b"\n" + struct.pack("<iI", layer, len(rects)) + b"".join(struct.pack("<4i", *r) for r in rects) + struct.pack("<I", len(objects)) + b"".join(struct.pack("<3i", *o) for o in objects)
    out += struct.pack("<I", len(buildings)) + b"".join(struct.pack(f"<I{len(b)}I", len(b), *b) for b in buildings)
    return out + bytes(zpop.get((x, y), 0) for x in range(side) for y in range(side))


def block_bytes(squares, size, layers, room=7, long_skips=True):
    """Runs over (layer, x, y) in order; squares map to lists of codes."""
    out, empty = b"", 0
    places = [(z, x, y) for z in range(*layers) for x in range(size) for y in range(size)]
    for place in [*places, None]:
        codes = squares.get(place) if place else None
        if place and not codes:
            empty += 1
            continue
        while empty:
            n = empty if long_skips else 1
            out += struct.pack("<ii", -1, n) if long_skips else struct.pack("<i", empty % 2)
            empty -= n
        if codes:
            out += struct.pack(f"<ii{len(codes)}i", len(codes) + 1, room, *codes)
    return out


def body_bytes(version, blocks, side, size, layers, **how):
    head = (b"LOTP" + struct.pack("<I", version) if version else b"") + struct.pack("<I", side * side)
    parts, at, table = [], len(head) + 8 * side * side, b""
    for k in range(side * side):
        part = block_bytes(blocks.get((k // side, k % side), {}), size, layers, **how)
        table += struct.pack("<II", at, 0)
        at += len(part)
        parts.append(part)
    return head + table + b"".join(parts)


@pytest.mark.parametrize(("version", "layers", "long"), [(0, (0, 3), True), (1, (-2, 3), True), (1, (-1, 2), False)])
def test_cells(spark, tmp_path, version, layers, long):
    form = binary.FORMATS[version]
    side, size = binary.CELL_BLOCKS[form], binary.BLOCK_SIZE[form]
    blocks = {(0, 0): {(layers[0], 0, 0): [1], (layers[0], 1, 2): [0, 2, 1], (layers[1] - 1, size - 1, size - 1): [2]}, (3, side - 1): {(0, 4, 4): [1, 1]}}
    rooms = [(b"kitchen", 0, [(1, 2, 3, 4), (4, 2, 1, 1)], [(9, 1, 1)]), (b"bad\xff", 1, [(0, 0, 2, 2)], [])]
    (tmp_path / "3_2.lotheader").write_bytes(header_bytes(version, ["a", "b ", "c"], layers, rooms, [[0, 1]], side, {(1, 2): 200}))
    (tmp_path / "world_3_2.lotpack").write_bytes(body_bytes(version, blocks, side, size, layers, long_skips=long))
    (tmp_path / "5_5.lotheader").write_bytes(header_bytes(version, ["a"], layers, [], [], side, {})[:-5])
    (tmp_path / "other.txt").write_text("no")
    heads = binary.read_headers(spark, str(tmp_path))
    good = heads.filter("error is null").first()
    assert (good.cx, good.cy, good.version, good.tiles, good.minlayer, good.maxlayer) == (3, 2, version, ["a", "b", "c"], *layers)
    assert [bytes(r.name) for r in good.rooms] == [b"kitchen", b"bad\xff"] and good.rooms[0].rects[0].h == 4 and good.buildings[0].rooms == [0, 1]
    assert [(r.cx, r.error[:10]) for r in heads.filter("error is not null").collect()] == [(5, "ValueError")]
    assert [tuple(r) for r in binary.population(heads).collect()] == [(3, 2, 1, 2, 200)]
    cell = side * size
    want = sorted((3 * cell + bx * size + x, 2 * cell + by * size + y, z, pos, "abc"[c]) for (bx, by), squares in blocks.items() for (z, x, y), codes in squares.items() for pos, c in enumerate(codes))
    named = binary.named(binary.read_squares(spark, str(tmp_path)), heads)
    assert sorted((r.sx, r.sy, r.layer, r.pos, r.tile) for r in named.collect()) == want
    assert {r.room for r in named.collect()} == {7}
    rooms_ = JOBS["rooms"](heads, form).collect()
    assert {(r.name, r.area, r.color) for r in rooms_} == {("kitchen", 13, "cyan"), ("bad\xff", 4, "cyan")}
    assert JOBS["locate"](named, heads, ["c"]).count() == 2
    assert JOBS["zombie"](binary.population(heads), form).first().asDict() == {"x": (3 * side + 1) * size, "y": (2 * side + 2) * size, "w": size, "h": size, "z": 200, "css": "#906f00"}
    assert JOBS["room_borders"](heads, form).count() > 0


def test_versions_must_agree(spark, tmp_path):
    (tmp_path / "0_0.lotheader").write_bytes(header_bytes(1, ["a"], (0, 1), [], [], 32, {}))
    (tmp_path / "world_0_0.lotpack").write_bytes(body_bytes(0, {}, 30, 10, (0, 1)))
    assert "version" in binary.read_squares(spark, str(tmp_path)).first().error


def test_prefabs_and_packs(spark, tmp_path):
    head = b"PZBY" + struct.pack("<II", 1, 2) + b"t0\nt1\n" + struct.pack("<3i", 1, 1, 2) + struct.pack("<II", 0, 0)
    attributes = struct.pack("<iii", 2, 5, -1) + struct.pack("<i", 200)
    data = struct.pack("<ii", -1, 9) + struct.pack("<4i", 4, 1, 0, 1) + struct.pack("<ii", -1, 500)
    (tmp_path / "a.pzby").write_bytes(head + struct.pack("<II", len(head) + 8, 0) + attributes + data)
    got = {(r.x, r.y, r.layer, r.attribute, r.pos, r.tile) for r in binary.read_prefabs(spark, str(tmp_path)).collect()}
    assert got == {(0, 0, 0, 5, None, None), (1, 1, 0, None, 0, "t1"), (1, 1, 0, None, 1, "t0"), (1, 1, 0, None, 2, "t1")}
    name = lambda s: struct.pack("<I", len(s)) + s
    page = name(b"page") + struct.pack("<II", 2, 1) + name(b"tex") + struct.pack("<8i", *range(8)) + name(b"two") + struct.pack("<8i", *range(8, 16))
    (tmp_path / "v0.pack").write_bytes(struct.pack("<I", 1) + page + b"PNG-0" + binary.PAGE_END)
    (tmp_path / "v1.pack").write_bytes(b"PZPK" + struct.pack("<II", 1, 1) + page + name(b"PNG-1"))
    rows = binary.read_packs(spark, str(tmp_path)).orderBy("path", "name").collect()
    assert [(r.name, r.oh, r.png and bytes(r.png)) for r in rows] == [("tex", 7, b"PNG-0"), ("two", 15, None), ("tex", 7, b"PNG-1"), ("two", 15, None)]


def test_save_chunks(spark):
    rows = [("x/map/12/34.bin", struct.pack(">bI", 1, 195)), ("x/map/map_5_6.bin", struct.pack(">bI", 1, 240)), ("x/map_7_8.bin", struct.pack(">bI", 0, 1)), ("x/map/readme.bin", b"")]
    got = binary.save_blocks(spark.createDataFrame(rows, "path string, content binary")).select("wx", "wy", binary.save_version().alias("v")).select("wx", "wy", "v.*").collect()
    assert sorted(map(tuple, got)) == [(5, 6, 240, "B42"), (7, 8, 1, "B41"), (12, 34, 195, "B41")]


LUA = """-- comment { [ "
other = { 1 }
objects = {
  { type = "Forest", name = 'a "b"', x = -3, y = 0x10, z = 0, width = 4, height = 5, properties = { k = "v" } }, --[[ long
  comment ]]
  { type = "Zone", z = 1, geometry = "polygon", points = { 1, 2.5, 3, 4 }; ["lineWidth"] = 2 },
}
function f() end
"""


def test_table_literals(spark, tmp_path):
    assert text.literal(LUA, "other") == [1]
    assert text.literal("a = { 1, x = 2 }", "a") == {"1": 1, "x": 2} and text.literal("a = {}", "a") == {} and text.literal("a = { [2] = 'b', [1] = 'a' }", "a") == ["a", "b"]
    with pytest.raises(ValueError, match="only literals"):
        text.literal("a = os.execute('x')", "a")
    (tmp_path / "objects.lua").write_text(LUA)
    rows = text.read_zones(spark, str(tmp_path)).orderBy("ord").collect()
    assert (rows[0].name, rows[0].x, rows[0].y, rows[0].properties) == ('a "b"', -3, 16, {"k": "v"})
    assert rows[1].points == [1.0, 2.5, 3.0, 4.0] and rows[1].lineWidth == 2
    zones = text.read_zones(spark, str(tmp_path))
    cells = JOBS["object_cells"](zones, {"Forest": "green", "Zone": "skip"}).collect()
    assert {(r.cx, r.cy, r.color) for r in cells} == {(-1, 0, "green"), (0, 0, "green")}
    marks_ = JOBS["objects"](zones, {"Forest": "green", "Zone": "skip"}).collect()
    assert [[tuple(q) for q in r.rects] for r in marks_] == [[(-3, 16, 4, 5)]] and marks_[0].type == "area"


def test_object_shapes(spark):
    """Polygons and polylines as covers of the squares whose middles they hold; older cells have 300 squares."""
    rows = [("f", 0, "F", "a", 1, 2, 0, 3, 4, None, None, None), ("f", 1, "F", None, None, None, 0, None, None, "polygon", [0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 2.0, 2.0, 2.0, 4.0, 0.0, 4.0], None), ("f", 2, "F", "line", None, None, 0, None, None, "polyline", [298.0, 10.0, 303.0, 10.0], 2), ("f", 3, "F", "no width", None, None, 0, None, None, "polyline", [0.0, 0.0, 9.0, 0.0], None), ("f", 4, "G", "other type", 1, 2, 0, 3, 4, None, None, None), ("f", 5, "F", "above", 1, 2, 1, 3, 4, None, None, None)]
    zones = spark.createDataFrame(rows, "path string, ord long, type string, name string, x long, y long, z long, width long, height long, geometry string, points array<double>, lineWidth long")
    got = {r.name: [tuple(q) for q in r.rects] for r in JOBS["objects"](zones, {"F": "green", "G": "skip"}).collect()}
    squares = lambda rects: {(x, y) for a, b, w, h in rects for x in range(a, a + w) for y in range(b, b + h)}
    assert set(got) == {"a", "", "line"} and got["a"] == [(1, 2, 3, 4)]
    assert squares(got[""]) == {(x, y) for x in range(4) for y in range(4) if x < 2 or y < 2}
    assert squares(got["line"]) == {(x, y) for x in range(298, 303) for y in (9, 10)}
    assert {r.cx for r in JOBS["object_cells"](zones.filter("ord = 2"), {"F": "green"}, form="B41").collect()} == {0, 1}
    assert {r.cx for r in JOBS["object_cells"](zones.filter("ord = 2"), {"F": "green"}).collect()} == {1}


def test_readers_list_only_their_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("1_2.lotheader", "world_1_2.lotpack", "sub/3_4.lotheader", "x.png"):
        (tmp_path / name).write_bytes(b"none")
    assert {f.rsplit("/", 1)[1] for f in binary.files(spark, str(tmp_path), binary.HEADER_NAME, "*.lotheader").inputFiles()} == {"1_2.lotheader", "3_4.lotheader"}
    assert binary.read_headers(spark, str(tmp_path)).filter("error is not null").count() == 2


def test_streets_and_rasters(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/streets.xml").write_text('<streets><street name="Main" width="9"><points><point x="0" y="1.5"/><point x="300" y="2"/></points></street><street name="B" width="2"><points><point x="0" y="0"/><point x="3" y="2"/></points></street></streets>')
    got = {r["name"]: r for r in JOBS["streets"](text.read_streets(spark, str(tmp_path / "s"))).collect()}
    assert got["Main"].visible_zoom_level == 1 and got["B"].visible_zoom_level == 2 and got["Main"].points[0].y == 1.5
    image = np.arange(24, dtype=np.uint8).reshape(4, 6)
    (tmp_path / "biomemap_1_-2.png").write_bytes(b"")
    (tmp_path / "biomemap_1_-2.png").unlink()
    (tmp_path / "biomemap_1_2.png").write_bytes(raster.png(image))
    pixels = text.read_rasters(spark, str(tmp_path))
    assert sorted((r.y, r.x, r.pixel) for r in pixels.collect()) == [(y, x, int(image[y, x])) for y in range(4) for x in range(6)]
    zones = spark.createDataFrame([(0, "F"), (1, "F"), (3, "F"), (4, "skip"), (7, "G")], "pixel int, zone string")
    runs = JOBS["foraging"](pixels, zones, {"F": "green", "skip": "skip"}).collect()
    assert sorted((r.x - 256, r.y - 512, r.w, r.color) for r in runs) == [(0, 0, 2, "green"), (3, 0, 1, "green")]


def test_png_filters():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    lines, before = b"", np.zeros(7, np.int64)
    for y, how in enumerate((0, 1, 2, 3, 4)):
        row = image[y].astype(np.int64)
        left, corner = np.concatenate([[0], row[:-1]]), np.concatenate([[0], before[:-1]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        lines += bytes([how]) + bytes(((row - [0 * row, left, before, (left + before) // 2, paeth][how]) % 256).astype(np.uint8))
        before = row
    whole = raster.png(image)
    at = whole.index(b"IDAT") - 4
    n = struct.unpack(">I", whole[at : at + 4])[0]
    data = zlib.compress(lines)
    filtered = whole[:at] + struct.pack(">I", len(data)) + b"IDAT" + data + b"\0\0\0\0" + whole[at + 12 + n :]
    assert text.grey_pixels(filtered) == (7, 5, image.tobytes())


def test_painted_pyramid(spark, tmp_path):
    rows = [(0, x, y, 0, 200, 0, 0, 255) for x in range(-8, 8) for y in range(0, 8)] + [(0, 3, 3, 1, 0, 0, 100, 255), (0, 2, 2, 2, 0, 0, 0, 0)]
    squares = spark.createDataFrame(rows, "layer int, x long, y long, ord int, r int, g int, b int, a int")
    tiles = raster.paint(squares, 4)
    assert {(r.tx, r.ty) for r in tiles.collect()} == {(x, y) for x in range(-2, 2) for y in range(2)}
    one = next(np.frombuffer(r.rgba, np.uint8).reshape(4, 4, 4) for r in tiles.collect() if (r.tx, r.ty) == (0, 0))
    assert one[3, 3].tolist() == [0, 0, 100, 255] and one[2, 2].tolist() == [200, 0, 0, 255]
    above = raster.shrink(tiles, 2)
    got = {(r.level, r.tx, r.ty) for r in above.collect()}
    assert got == {(1, -1, 0), (1, 0, 0), (2, -1, 0), (2, 0, 0)}
    plain = next(np.frombuffer(r.rgba, np.uint8).reshape(4, 4, 4) for r in above.collect() if (r.level, r.tx) == (1, -1))
    assert plain[0, 0].tolist() == [200, 0, 0, 255]
    raster.write_tiles(tiles.union(above), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12
    assert json.loads(raster.map_info(tiles, sqr=1).first().json) == {"minlayer": 0, "maxlayer": 1, "levels": 0, "tiles": 8, "sqr": 1}


def test_mark_layout_prunes(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 20).alias("x"), F.expr("id div 20").alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"), (F.col("id") % 2).cast("int").alias("layer"), (F.col("id") % 3).cast("int").alias("visible_zoom_level"))
    boxed = marks.boxed(df)
    marks.laid_out(boxed, str(tmp_path / "m"), 4)
    stored = spark.read.parquet(str(tmp_path / "m"))
    shown = marks.viewport(stored, (3, 3, 9, 9), 1, 1, limit=0)
    assert sorted(r.id for r in shown.collect()) == sorted(r.id for r in marks.viewport(boxed, (3, 3, 9, 9), 1, 1, limit=0).collect())
    plan = shown._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "PushedFilters: [IsNotNull(" in plan


def test_stream_folds_batches(spark, tmp_path):
    seen = []
    batch = lambda n, rows: spark.createDataFrame(rows, streaming.SOURCE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # noqa: E731, ARG005

    def run():
        streaming.follow(streaming.source_stream(spark, str(tmp_path / "in")), str(tmp_path / "snap"), str(tmp_path / "ck"), lambda df, n: seen.append((n, sorted((r.ux, r.uy, r.state) for r in df.collect())))).awaitTermination(120)

    batch(0, [(1, 1, 5, "a"), (1, 1, 6, "b"), (2, 2, 5, "c")])
    run()
    batch(1, [(1, 1, 7, "a"), (1, 1, 7, "b"), (2, 2, 9, "d"), (3, 3, 1, "e")])
    run()
    assert seen == [(0, [(1, 1, "appeared"), (2, 2, "appeared")]), (1, [(2, 2, "changed"), (3, 3, "appeared")])]
    assert {(r.ux, tuple(r.sigs)) for r in spark.read.parquet(str(tmp_path / "snap/1")).collect()} == {(1, ("a", "b")), (2, ("d",)), (3, ("e",))}


def test_stale_by_epsilon(spark):
    sources = spark.createDataFrame([(0, 0, 10.0), (1, 0, 10.0), (2, 0, 10.0)], "tx long, ty long, mtime double")
    done = spark.createDataFrame([(0, 0, 11.0), (1, 0, 10.9)], "tx long, ty long, mtime double")
    assert {r.tx for r in incremental.stale(sources, done, ["tx", "ty"], 1.0).collect()} == {1, 2}
