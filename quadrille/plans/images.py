"""Queries over images and what lies beside them: compositing, crops, deletions, descriptions, textures, marks (A19, K1-K7, K10, X3, jobs)."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import raster, textures
from ..sources import binary, file_sink
from ..storage import reliable, shared_dir
from .catalogue import query
from .decoding import le, sized
from .jobs import JOBS
from .views import view

TILE = 64
_COLOUR = "printf('%02x%02x%02xff', id * 7 % 256, id * 13 % 256, id * 29 % 256)"
#: Pixels of all parts drawn as opaque rectangles at their places, moved by their offsets.
_DRAWN = f"d AS (SELECT layer, id, x + id % 5 - 2 + i AS x, y + id % 3 - 1 + j AS y, {_COLOUR} AS colour FROM v_rects, range(12) a(i), range(9) b(j) WHERE i < w AND j < h)"


def _textures(spark, d):
    """A texture of one colour for each part."""
    c = F.col("id")
    colour = F.format_string("%02x%02x%02xff", c * 7 % 256, c * 13 % 256, c * 29 % 256)
    size = [F.col(n).cast("int").alias(n) for n in "wh"]
    return view(spark, d, "v_rects").select(c.cast("string").alias("name"), (c % 5 - 2).cast("int").alias("ox"), (c % 3 - 1).cast("int").alias("oy"), *size, F.unhex(F.repeat(colour, (F.col("w") * F.col("h")).cast("int"))).alias("rgba"))


def _tiles(spark, d):
    draws = view(spark, d, "v_rects").select("layer", F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("ord"), F.col("id").cast("string").alias("name"))
    return raster.compose(draws, _textures(spark, d), TILE)


@query(f"WITH {_DRAWN} SELECT layer, x, y, arg_max(colour, id) AS colour FROM d GROUP BY layer, x, y")
def A19_composited_pixels(spark, d):
    return raster.pixels(_tiles(spark, d)).select("layer", "x", "y", "colour")


@query(f"""WITH d AS (SELECT layer, (x + y) * 100000000000000 + (x - y + 1000) * 10000000000 + id AS ord, (x - y) * 4 + id % 5 - 2 + i AS px, (x + y - 6 * layer) * 2 + 2 + id % 3 - 1 + j AS py, {_COLOUR} AS colour FROM v_rects, range(12) a(i), range(9) b(j) WHERE i < w AND j < h)
  SELECT layer, px AS x, py AS y, arg_max(colour, ord) AS colour FROM d GROUP BY 1, 2, 3""")
def job_base(spark, d):
    """The isometric image at a sixteenth of its size: squares four pixels apart."""
    squares = view(spark, d, "v_rects").select("layer", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("id").alias("pos"), F.col("id").cast("string").alias("tile"))
    return raster.pixels(JOBS["base"](squares, _textures(spark, d), TILE, (4, 2))).select("layer", "x", "y", "colour")


@query("""WITH s AS (SELECT square % 100 AS sx, square // 100 AS sy, line % 3 AS layer, tile FROM v_stacks), c AS (SELECT layer, sx, sy, CAST(floor(sum(sum_r) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS r, CAST(floor(sum(sum_g) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS g, CAST(floor(sum(sum_b) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS b FROM s JOIN v_textures USING (tile) GROUP BY 1, 2, 3)
  SELECT layer, sx, sy, printf('#%02x%02x%02x', r, g, b) AS css FROM c""")
def job_base_top(spark, d):
    s = view(spark, d, "v_stacks").select((F.col("line") % 3).alias("layer"), (F.col("square") % 100).alias("sx"), F.expr("square div 100").alias("sy"), F.col("line").alias("pos"), "tile")
    return JOBS["base_top"](s, view(spark, d, "v_textures"))


@query("SELECT s.line % 3 AS layer, s.square % 100 AS sx, s.square // 100 AS sy, s.line AS pos, 'tile_' || t.tile AS tile FROM v_stacks s JOIN v_textures t ON s.tile = t.tile")
def job_save(spark, d):
    sprites = view(spark, d, "v_stacks").select((F.col("line") % 3).alias("layer"), (F.col("square") % 100).alias("x"), F.expr("square div 100").alias("y"), F.col("line").alias("pos"), F.col("tile").alias("sprite"))
    names = view(spark, d, "v_textures").select(F.col("tile").alias("sprite"), F.concat(F.lit("tile_"), "tile").alias("tile"))
    return JOBS["save"](sprites, names)


@query(f"""WITH {_DRAWN}, t AS (SELECT layer, CAST(floor(x / 64.0) AS BIGINT) AS tx, CAST(floor(y / 64.0) AS BIGINT) AS ty, bool_or(x < 200 AND y < 150) AS seen FROM d GROUP BY 1, 2, 3)
  SELECT layer, tx, ty, greatest(0, least(64, 200 - tx * 64)) AS w, greatest(0, least(64, 150 - ty * 64)) AS h, CASE WHEN seen THEN 'saved' ELSE 'empty' END AS state, CASE WHEN seen AND layer = 0 THEN 'rgb' WHEN seen THEN 'rgba' END AS kind, CASE WHEN seen THEN greatest(0, least(64, 200 - tx * 64)) END AS png_w FROM t""")
def K1_K2_cropped_tiles(spark, d):
    """Tiles cut to an image of 200 by 150; the ground without alpha; size and kind are read from the PNG itself."""
    t = raster.cropped(_tiles(spark, d), 200, 150, (0,))
    kind = F.when(F.hex(F.substring("png", 26, 1)) == "02", "rgb").when(F.hex(F.substring("png", 26, 1)) == "06", "rgba")
    size = F.conv(F.hex(F.substring("png", 17, 4)), 16, 10).cast("bigint")
    return t.select("layer", "tx", "ty", F.col("w").cast("bigint").alias("w"), F.col("h").cast("bigint").alias("h"), "state", kind.alias("kind"), size.alias("png_w"))


@query("""WITH t AS (SELECT DISTINCT layer, w % 3 AS level, x AS tx, y AS ty FROM v_rects), gone AS (SELECT DISTINCT level, tx, ty FROM t WHERE layer = 2), saved AS (SELECT * FROM t WHERE level = 1 AND layer = 0)
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.level = t.level AND g.tx = t.tx AND g.ty = t.ty) AND NOT EXISTS (SELECT 1 FROM saved s WHERE s.layer = t.layer AND t.level = 0 AND s.tx = t.tx // 2 AND s.ty = t.ty // 2)""")
def K4_deleted_tiles(spark, d):
    """Tiles of one layer go from all layers, and so do children below a tile that was saved again, of its layer."""
    t = view(spark, d, "v_rects").select("layer", (F.col("w") % 3).alias("level"), F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    return raster.without_children(raster.without_tiles(t, t.filter("layer = 2")), t.filter("layer = 0"), 1)


@query("""SELECT DISTINCT layer, 'layer' || layer || '.dzi' AS path, '<?xml version="1.0" encoding="UTF-8"?><Image xmlns="http://schemas.microsoft.com/deepzoom/2008" TileSize="64" Overlap="0" Format="' || CASE WHEN layer = 0 THEN 'jpg' ELSE 'png' END || '"><Size Width="51" Height="38"/></Image>' AS content FROM v_rects""")
def K5_image_descriptions(spark, d):
    return raster.skeleton(view(spark, d, "v_rects"), 201, 150, TILE, ground="jpg", skip=2)


@query("SELECT id AS name, CASE WHEN id % 4 = 0 THEN 0 ELSE 3 + id % 2 END AS ox, CASE WHEN id % 4 = 0 THEN 0 ELSE 7 END AS oy, CASE WHEN id % 4 = 0 THEN 0 ELSE w END AS w, CASE WHEN id % 4 = 0 THEN 0 ELSE h END AS h FROM v_rects")
def K10_trimmed_textures(spark, d):
    """Textures with two columns before, one behind and a row above and below that are transparent; every fourth is all transparent."""
    clear, c = "00000000", F.col("id")
    row = F.concat(F.lit(clear * 2), F.repeat(F.when(c % 4 == 0, clear).otherwise("0a0b0c40"), F.col("w").cast("int")), F.lit(clear))
    blank = F.repeat(F.lit(clear), (F.col("w") + 3).cast("int"))
    digits = F.concat(blank, F.repeat(row, F.col("h").cast("int")), blank)
    t = view(spark, d, "v_rects").select(c.cast("string").alias("name"), (1 + c % 2).cast("int").alias("ox"), F.lit(6).alias("oy"), (F.col("w") + 3).cast("int").alias("w"), (F.col("h") + 2).cast("int").alias("h"), F.unhex(digits).alias("rgba"))
    return raster.trimmed(t).select(F.col("name").cast("bigint").alias("name"), *(F.col(n).cast("bigint").alias(n) for n in ("ox", "oy", "w", "h")))


@query("""WITH s AS (SELECT x * 4 - 4 + i AS px, y * 4 - 2 + j AS py, id FROM v_rects, range(8) a(i), range(4) b(j) WHERE layer = 0 AND abs(2 * i + 1 - 8) / 8.0 + abs(2 * j + 1 - 4) / 4.0 <= 1)
  SELECT px AS x, py AS y, CASE max_by(id, id) % 2 WHEN 0 THEN 'ff000080' ELSE '00ff0080' END AS colour, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2 HAVING count(*) = 1""")
def X3_diamonds(spark, d):
    """Squares of the ground filled as half transparent diamonds; the pixels that only one covers."""
    squares = view(spark, d, "v_rects").filter("layer = 0").select("layer", (F.col("x") * 4).alias("px"), (F.col("y") * 4).alias("py"), F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "red").otherwise("lime").alias("name"))
    colours = spark.sql("SELECT * FROM VALUES ('red', 255, 0, 0, 128), ('lime', 0, 255, 0, 128) AS t(name, r, g, b, a)")
    p = raster.pixels(raster.compose(squares, raster.shapes(colours, 8, 4), TILE))
    return p.filter("colour in ('ff000080', '00ff0080')").select("x", "y", "colour", F.lit(1).cast("bigint").alias("n"))


@query("""SELECT layer, x, y, '[' || chr(10) || string_agg('{"id":' || id || ',"name":' || CAST(to_json(name) AS VARCHAR) || ',"w":' || w || '}', ',' || chr(10) ORDER BY id) || chr(10) || ']' AS json FROM v_rects GROUP BY layer, x, y""")
def K7_mark_arrays(spark, d):
    return raster.mark_array(view(spark, d, "v_rects").select("layer", "x", "y", "id", "name", "w"), ["layer", "x", "y"])


#: Pages of the packs: 64 parts on a page, in eight columns of 12 by 9 pixels; the first line and the left column of every
#: fifth part are transparent, and so is every seventh pixel; names are shared by parts of many packs.
_PAGE = """pg AS (SELECT id // 64 AS pack, id, 'tile_' || id % 700 AS name, w, h, id % 7 AS ox, id % 5 AS oy, i, j, (id * 7 + i * 3) % 256 AS r, (id * 13 + j * 5) % 256 AS g, id * 29 % 256 AS b
  FROM v_rects, range(12) a(i), range(9) b(j) WHERE i < w AND j < h AND NOT (id % 5 = 0 AND (i = 0 OR j = 0)) AND (i + 2 * j + id) % 7 <> 0),
  lib AS (SELECT name, arg_max(id, id) AS id FROM (SELECT 'tile_' || id % 700 AS name, id FROM v_rects) GROUP BY name)"""


#: Packs that a task makes and reads; a task's Python holds the pages of all of them.
PACKS_EACH = 128


def _pack_files(spark, d):
    """A pack of one page for each 64 parts, in both versions of the format; lines of the images have all kinds of filters.

    Rows of parts are small and images are not, so that tasks are as many as the packs ask for.
    """
    parts = view(spark, d, "v_rects")
    tasks = 1 + parts.count() // (64 * PACKS_EACH)
    r = parts.withColumn("pack", F.expr("id div 64")).withColumn("k", F.col("id") % 64).repartition(tasks, "pack")

    encode = raster.png  # workers get the function, not all of its module

    @F.pandas_udf(T.BinaryType())
    def page(parts: pd.Series) -> pd.Series:
        out = []
        for rows in parts:
            image = np.zeros((72, 96, 4), np.uint8)
            for t in rows:
                n, w, h = t["id"], t["w"], t["h"]
                i, j = np.arange(w)[None, :], np.arange(h)[:, None]
                seen = ((i + 2 * j + n) % 7 != 0) & ~((n % 5 == 0) & ((i == 0) | (j == 0)))
                colour = np.stack(np.broadcast_arrays((n * 7 + i * 3) % 256, (n * 13 + j * 5) % 256, n * 29 % 256, 255), axis=-1)
                image[t["k"] // 8 * 9 :, t["k"] % 8 * 12 :][:h, :w] = colour * seen[..., None]
            out.append(encode(image, np.arange(72) % 5))
        return pd.Series(out)

    items = r.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("id", "k", "w", "h"))).alias("items"))  # 64 at most
    place = lambda t: (t["k"] % 8 * 12, F.floor(t["k"] / 8) * 9, t["w"], t["h"], t["id"] % 7, t["id"] % 5, t["w"], t["h"])
    textures = F.array_join(F.transform("items", lambda t: F.concat(sized(F.concat(F.lit("tile_"), t["id"] % 700)), *(le(c) for c in place(t)))), "")
    new, png = F.col("pack") % 2 == 1, F.hex(page("items"))
    start = F.concat(F.when(new, F.concat(F.hex(F.lit("PZPK")), le(1))).otherwise(""), le(1), sized(F.lit("page")), le(F.size("items")), le(1), textures)
    content = F.concat(start, F.when(new, F.concat(le(F.length(png) / 2), png)).otherwise(F.concat(png, F.lit("EFBEADDE"))))
    return items.select(F.format_string("/packs/%d.pack", "pack").alias("path"), F.unhex(content).alias("content"))


def _pack_number(frame_path: str = "path"):
    return F.regexp_extract(frame_path, r"(\d+)\.pack$", 1).cast("bigint")


def _library(spark, d):
    return reliable(textures.library(textures.cut(binary.pages(_pack_files(spark, d)).filter("error is null")), _pack_number()))  # used more than once


@query(f"""WITH {_PAGE} SELECT '/packs/' || pack || '.pack' AS path, name, id // 64 * 64 = id AS first, min(i) + any_value(ox) - any_value(w) // 2 AS ox, min(j) + any_value(oy) - any_value(h) AS oy, max(i) - min(i) + 1 AS w, max(j) - min(j) + 1 AS h,
  CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b, count(*) AS n FROM pg GROUP BY pack, name, id""")
def S10_A1_textures_of_pages(spark, d):
    """Textures cut from decoded pages: where they are trimmed to, and their colour sums."""
    cut = textures.cut(binary.pages(_pack_files(spark, d)).filter("error is null")).filter("error is null and w > 0")
    return cut.select("path", "name", (F.col("ord") == 0).alias("first"), *(F.col(c).cast("bigint").alias(c) for c in ("ox", "oy", "w", "h")), textures.pixel_sums("rgba").alias("s")).select("*", "s.*").drop("s")


@query(f"""WITH {_PAGE} SELECT l.name, CAST(coalesce(sum(r), 0) AS BIGINT) AS sum_r, CAST(coalesce(sum(g), 0) AS BIGINT) AS sum_g, CAST(coalesce(sum(b), 0) AS BIGINT) AS sum_b, greatest(count(r), 1) AS n FROM lib l LEFT JOIN pg ON pg.id = l.id GROUP BY l.name""")
def A1_A2_library_sums(spark, d):
    """Colour sums of the textures that win in a library of all packs, later packs over earlier ones."""
    return textures.colour_sums(_library(spark, d))


@query("""WITH l AS (SELECT 'tile_' || id % 700 AS name, arg_max(id, id) AS id FROM v_rects GROUP BY 1)
  SELECT l.name, id // 64 AS page_id, id % 8 * 12 AS x, id % 64 // 8 * 9 AS y, w, h, id % 7 - w // 2 AS ox, id % 5 - h AS oy FROM l JOIN v_rects USING (id)""")
def X26_atlas_pages(spark, d):
    a = textures.atlas(binary.pages(_pack_files(spark, d)).filter("error is null"), _pack_number())
    return a.select("name", *(F.col(c).cast("bigint").alias(c) for c in ("page_id", "x", "y", "w", "h", "ox", "oy")))


@query(f"""WITH {_PAGE}, q AS (SELECT s.layer, s.id AS ord, (s.x - s.y) * 4 + t.ox - t.w // 2 + t.i AS x, (s.x + s.y - 6 * s.layer) * 2 + 2 + t.oy - t.h + t.j AS y, s.x + s.y AS gy, s.x - s.y AS gx, printf('%02x%02x%02xff', t.r, t.g, t.b) AS colour
  FROM v_rects s JOIN lib l ON l.name = 'tile_' || s.id % 700 JOIN pg t ON t.id = l.id)
  SELECT layer, x, y, arg_max(colour, (gy + 1000) * 10000000000000 + (gx + 1000) * 1000000000 + ord) AS colour FROM q GROUP BY layer, x, y""")
def job_base_from_packs(spark, d):
    """The isometric image with textures out of packs: decoded, cut, overridden, trimmed and composited."""
    squares = view(spark, d, "v_rects").select("layer", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("id").alias("pos"), F.concat(F.lit("tile_"), F.col("id") % 700).alias("tile"))
    return raster.pixels(JOBS["base"](squares, _library(spark, d), TILE, (4, 2))).select("layer", "x", "y", "colour")


@query(f"""WITH {_DRAWN}, p AS (SELECT layer, x, y, arg_max(colour, id) AS colour FROM d GROUP BY layer, x, y)
  SELECT layer, CAST(k AS BIGINT) AS level, CAST(floor(x / pow(2, k)) AS BIGINT) AS x, CAST(floor(y / pow(2, k)) AS BIGINT) AS y, colour FROM p, range(0, 7) t(k) WHERE x % (1 << k) = 0 AND y % (1 << k) = 0""")
def A13_image_pyramid(spark, d):
    """Six levels above tiles of eight pixels, in three steps: a pixel of a level is the upper left one below it."""
    draws = view(spark, d, "v_rects").select("layer", F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("ord"), F.col("id").cast("string").alias("name"))
    tiles = raster.image_pyramid(raster.compose(draws, _textures(spark, d), 8), 6, raster.nearest_half, step=2)
    return raster.pixels(tiles).withColumn("level", F.col("level").cast("bigint"))


@query(f"""WITH {_DRAWN}, p AS (SELECT layer, x, y, arg_max(colour, id) AS colour FROM d WHERE x > -1 AND y > -1 GROUP BY layer, x, y), s AS (SELECT layer, k, x >> k AS x, y >> k AS y FROM p, range(0, 6) t(k) WHERE x % (1 << k) = 0 AND y % (1 << k) = 0)
  SELECT layer, CAST(k AS BIGINT) AS level, x >> 3 AS tx, y >> 3 AS ty, greatest(0, least(8, (199 >> k) + 1 - (x >> 3) * 8)) AS w, greatest(0, least(8, (149 >> k) + 1 - (y >> 3) * 8)) AS h
  FROM s WHERE x <= 199 >> k AND y <= 149 >> k GROUP BY ALL""")
def K1_crops_of_levels(spark, d):
    """Tiles of all levels cut to an image of 200 by 150 pixels, halved from level to level; those that have something to see."""
    draws = view(spark, d, "v_rects").select("layer", F.col("x").alias("px"), F.col("y").alias("py"), F.col("id").alias("ord"), F.col("id").cast("string").alias("name"))
    tiles = raster.image_pyramid(raster.compose(draws, _textures(spark, d), 8).filter("tx >= 0 and ty >= 0"), 5, raster.nearest_half)
    t = raster.cropped(tiles, 200, 150).filter("state = 'saved'")
    return t.select("layer", *(F.col(c).cast("bigint").alias(c) for c in ("level", "tx", "ty", "w", "h")))


@query(f"""WITH {_DRAWN}, t AS (SELECT layer, CAST(floor(x / 64.0) AS BIGINT) AS tx, CAST(floor(y / 64.0) AS BIGINT) AS ty, bool_or(x < 200 AND y < 150) AS seen FROM d GROUP BY 1, 2, 3)
  SELECT layer, CAST(0 AS BIGINT) AS level, tx, ty, 'png' AS kind FROM t WHERE seen AND (tx + ty) % 2 <> 0""")
def K1_K2_tile_files(spark, d):
    """Tiles as files; a second write makes every other one empty; the images that are then left (Spark's reader passes over empty files)."""
    path = f"{shared_dir(spark).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    tiles = raster.cropped(_tiles(spark, d), 200, 150)
    file_sink.write_files(file_sink.tile_files(tiles), path)
    file_sink.write_files(file_sink.tile_files(tiles.filter("(tx + ty) % 2 = 0").withColumn("state", F.lit("empty"))), path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    part = lambda i: F.regexp_extract("path", r"layer(-?\d+)_files/(\d+)/(-?\d+)_(-?\d+)\.(\w+)$", i)
    return found.select(*(part(i).cast("bigint").alias(n) for i, n in enumerate(("layer", "level", "tx", "ty"), 1)), part(5).alias("kind"))
