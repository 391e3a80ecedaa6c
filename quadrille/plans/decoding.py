"""Queries that decode files: cells of 64 parts written as headers, bodies, prefabs, packs, saves, table literals, XML and images (S1-S18, A6, jobs).

The files' bytes are built from the tables by expressions on hexadecimal digits, so that a decoder reads whole tables back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.raster import to_png
from ..operators.relational import quarantined, write_languages
from ..sources import binary as B
from ..sources import encoders as E
from ..sources import text as S
from ..storage import reliable, shared_dir, tasks_for
from .catalogue import query
from .jobs import JOBS
from .views import view

#: The parts as items of cells in SQL: cell (cx, cy), rank k of n in the cell, version 0 or 1 by turns.
_C = "c AS (SELECT *, id // 64 % 50 AS cx, id // 64 // 50 AS cy, CAST(row_number() OVER (PARTITION BY id // 64 ORDER BY id) - 1 AS BIGINT) AS k, CAST(count(*) OVER (PARTITION BY id // 64) AS BIGINT) AS n FROM v_rects)"


#: Sizes of both formats: a block's side and a cell's, by the parity of cx.
_B, _S = "(10 - cx % 2 * 2)", "(300 - cx % 2 * 44)"


def le(c) -> Column:
    """A number as four bytes, the least first, in hexadecimal digits."""
    digits = F.lpad(F.hex((c if isinstance(c, Column) else F.lit(c)).cast("bigint")), 16, "0")
    return F.concat(*(F.substring(digits, at, 2) for at in (15, 13, 11, 9)))


def _line(text) -> Column:
    return F.concat(F.hex(text), F.lit("0A"))


def sized(text) -> Column:
    return F.concat(le(F.octet_length(text)), F.hex(text))


def _all(items, one) -> Column:
    return F.array_join(F.transform(items, one), "")


def _runs(items, place, payload, end) -> Column:
    """A run-length coded block of `end` squares with items at rising places; gaps are written as -1 and their length."""
    gap = lambda g: F.when(g > 0, F.concat(le(-1), le(g))).otherwise("")
    before = lambda k: F.when(k > 0, place(F.get(items, k - 1))).otherwise(-1)
    parts = F.transform(items, lambda r, k: F.concat(gap(place(r) - before(k) - 1), payload(r)))
    return F.concat(F.array_join(parts, ""), gap(end - 1 - before(F.size(items))))


def _cells(spark, d):
    """(cx, cy, version, items): parts in order of id, each with its rank k; a cell holds 64 at most.

    Rows of parts are small and files are not, so that tasks are as many as the cells ask for.
    """
    parts = view(spark, d, "v_rects")
    r = parts.withColumn("cell", F.expr("id div 64")).repartition(tasks_for(parts), "cell")
    packed = r.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("id", "name", "layer", "x", "y", "w", "h", "type"))).alias("items"))
    ranked = F.transform("items", lambda i, k: i.withField("k", k.cast("bigint")))
    return packed.select((F.col("cell") % 50).alias("cx"), F.expr("cell div 50").alias("cy"), (F.col("cell") % 50 % 2).alias("version"), ranked.alias("items"))


def _file(frame, pattern: str, content: Column):
    name = F.format_string(pattern, "cx", "cy")
    return frame.select(F.concat(F.lit("/maps/"), name).alias("path"), name.alias("name"), F.unhex(content).alias("content"))


def _head_files(spark, d):
    items, new = F.col("items"), F.col("version") == 1
    side = F.when(new, 32).otherwise(30)
    place = lambda k: F.floor(k / 4) * side + k % 4 * 7
    rooms = _all(items, lambda r: F.concat(_line(r["name"]), le(r["layer"]), le(1), *(le(r[c]) for c in "xywh"), le(0)))
    people = _all(items, lambda r: F.concat(F.repeat(F.lit("00"), (place(r["k"]) - F.when(r["k"] > 0, place(r["k"] - 1)).otherwise(-1) - 1).cast("int")), F.lpad(F.hex(F.when(r["id"] % 5 == 0, 0).otherwise(r["w"] * r["h"])), 2, "0")))
    rest = F.repeat(F.lit("00"), (side * side - 1 - place(F.size(items) - 1)).cast("int"))
    content = F.concat(
        F.when(new, F.hex(F.lit("LOTH"))).otherwise(""), le(F.col("version")), le(F.size(items)), _all(items, lambda r: _line(r["name"])),
        F.when(new, "").otherwise("00"), le(8), le(8), F.when(new, le(0)).otherwise(""), F.when(new, le(2)).otherwise(le(3)),
        le(F.size(items)), rooms, le(1), le(F.size(items)), _all(items, lambda r: le(r["k"])), people, rest)
    return _file(_cells(spark, d), "%d_%d.lotheader", content)


@query(f"WITH {_C} SELECT cx, cy, CAST(cx % 2 AS BIGINT) AS version, k AS room, name, layer, x, y, w, h, CAST(0 AS BIGINT) AS minlayer, CAST(3 AS BIGINT) AS maxlayer, n AS in_building FROM c")
def S3_S5_header_rooms(spark, d):
    h = B.headers(_head_files(spark, d)).filter("error is null")
    r = h.select("cx", "cy", "version", "minlayer", "maxlayer", F.size(F.col("buildings")[0]["rooms"]).alias("in_building"), F.explode("rooms").alias("r"))
    wide = r.select("cx", "cy", "version", F.col("r.id").alias("room"), F.decode("r.name", "utf-8").alias("name"), "r.layer", *(F.col("r.rects")[0][c].alias(c) for c in "xywh"), "minlayer", "maxlayer", "in_building")
    return wide.select(*(F.col(c) if c == "name" else F.col(c).cast("bigint").alias(c) for c in wide.columns))


@query(f"WITH {_C} SELECT DISTINCT cx, cy, 'ValueError' AS kind, 'body' AS part FROM c WHERE cx % 7 = 3 UNION ALL SELECT DISTINCT cx, cy, 'KeyError', 'header' FROM c WHERE cx % 7 = 5")
def K11_quarantined_files(spark, d):
    """Bodies that end too early and headers of an unknown version: each is one row with its error, the others decode."""
    cx = F.regexp_extract("name", r"(\d+)_", 1).cast("int")
    heads = _head_files(spark, d)
    unknown = F.concat(F.unhex(F.concat(F.hex(F.lit("LOTH")), le(9))), F.lit(b"\0" * 64))
    broken = heads.withColumn("content", F.when(cx % 7 == 5, unknown).otherwise(F.col("content")))
    bodies = _body_files(spark, d).withColumn("content", F.when(cx % 7 == 3, F.substring("content", 1, 200)).otherwise(F.col("content")))
    kind = F.regexp_extract("error", r"^(\w+):", 1)
    out = quarantined(B.squares(bodies, heads), ["cx", "cy"]).withColumn("part", F.lit("body")).union(quarantined(B.headers(broken), ["cx", "cy"]).withColumn("part", F.lit("header")))
    return out.select(F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), kind.alias("kind"), "part")


@query("SELECT conv_id || '-' || turn AS key, lang, text FROM v_texts WHERE text IS NOT NULL")
def K13_language_files(spark, d):
    """Texts written as JSON, a folder for each language, and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/languages-{uuid.uuid4().hex}"
    write_languages(view(spark, d, "v_texts").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "lang", "text").filter("text is not null"), path)
    return spark.read.schema("key string, text string, lang string").json(path).select("key", "lang", "text")


@query(f"WITH {_C} SELECT cx, cy, k AS code, trim(name) AS tile FROM c")
def S4_tile_dictionary(spark, d):
    h = B.headers(_head_files(spark, d)).filter("error is null")
    return h.select(F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), F.posexplode("tiles").alias("code", "tile")).withColumn("code", F.col("code").cast("bigint"))


@query(f"""WITH {_C} SELECT cx, cy, k // 4 AS bx, k % 4 * 7 AS "by", w * h AS z FROM c WHERE id % 5 <> 0""")
def S6_F5_population_decoded(spark, d):
    p = B.population(B.headers(_head_files(spark, d)))
    return p.select(*(F.col(c).cast("bigint").alias(c) for c in ("cx", "cy", "bx", "by", "z")))


@query(f"""WITH {_C} SELECT (cx * (30 + cx % 2 * 2) + k // 4) * (10 - cx % 2 * 2) AS x, (cy * (30 + cx % 2 * 2) + k % 4 * 7) * (10 - cx % 2 * 2) AS y, 10 - cx % 2 * 2 AS size, w * h AS z,
  printf('#%02x%02x%02x', CASE WHEN w * h >= 128 THEN (w * h - 128) * 2 ELSE 0 END, CASE WHEN w * h >= 128 THEN 255 - (w * h - 128) * 2 ELSE w * h * 2 END, CASE WHEN w * h >= 128 THEN 0 ELSE 255 - w * h * 2 END) AS css FROM c WHERE id % 5 <> 0""")
def job_zombie(spark, d):
    people = B.population(B.headers(_head_files(spark, d)))
    out = JOBS["zombie"](people.filter("cx % 2 = 0"), "B41").union(JOBS["zombie"](people.filter("cx % 2 = 1"), "B42"))
    return out.select(*(F.col(c).cast("bigint").alias(c) for c in "xy"), F.col("w").cast("bigint").alias("size"), F.col("z").cast("bigint").alias("z"), "css")


@query(f"""WITH {_C}, r AS (SELECT *, x + cx * {_S} AS rx, y + cy * {_S} AS ry, row_number() OVER (PARTITION BY layer, x + cx * {_S}, y + cy * {_S}, w, h ORDER BY k DESC) AS latest FROM c)
  SELECT cx || '-' || cy || '-' || k AS id, name, layer, w * h AS area, rx AS x, ry AS y, w AS width, h AS height FROM r WHERE latest = 1""")
def job_rooms(spark, d):
    """Rooms of cells of both formats as area marks; A6's areas."""
    heads = B.headers(_head_files(spark, d))
    r = JOBS["rooms"](heads).select("id", "name", F.col("layer").cast("bigint").alias("layer"), "area", F.col("rects")[0].alias("q"))
    return r.select("id", "name", "layer", "area", *(F.col(f"q.{c}").cast("bigint").alias(c) for c in ("x", "y", "width", "height")))


@query(f"""WITH {_C}, s AS (SELECT DISTINCT cx, cy, k AS room, x + cx * {_S} + i AS x, y + cy * {_S} + j AS y, i = 0 AS west, j = 0 AS north, i = w - 1 AS east, j = h - 1 AS south FROM c, range(12) a(i), range(9) b(j) WHERE i < w AND j < h)
  SELECT cx, cy, room, CAST(count(*) AS BIGINT) AS squares, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM s WHERE west OR north OR east OR south GROUP BY cx, cy, room""")
def job_room_borders(spark, d):
    b = JOBS["room_borders"](B.headers(_head_files(spark, d)), tasks=tasks_for(view(spark, d, "v_rects")))
    keys = [F.col(c).cast("bigint").alias(c) for c in ("cx", "cy", "room")]
    return b.groupBy(*keys).agg(F.count("*").alias("squares"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


def _body_files(spark, d):
    """Each four items are the squares of a block, at rising places; an item has as many tiles as its layer and one more."""
    items = F.col("items")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: _runs(
        F.filter(items, lambda r: F.floor(r["k"] / 4) == b), lambda r: r["k"] % 4 * 16 + r["w"],
        lambda r: F.concat(le(r["layer"] + 2), le(r["h"]), _all(F.sequence(F.lit(0).cast("bigint"), r["layer"]), lambda i: le((r["k"] * 7 + i) % F.size(items)))), F.when(F.col("version") == 1, 192).otherwise(300)))
    cells = _cells(spark, d).withColumn("blocks", blocks)
    head = F.when(F.col("version") == 1, F.concat(F.hex(F.lit("LOTP")), le(1))).otherwise("")
    start = F.when(F.col("version") == 1, 140).otherwise(132)
    table = F.array_join(F.transform("blocks", lambda b, k: F.concat(le(start + F.aggregate(F.slice("blocks", F.lit(1), k), F.lit(0).cast("bigint"), lambda s, x: s + (F.length(x) / 2).cast("bigint"))), le(0))), "")
    return _file(cells, "world_%d_%d.lotpack", F.concat(head, le(16), table, F.array_join("blocks", "")))


_SQUARES = f"""WITH {_C}, s AS (SELECT *, k % 4 * 16 + w AS p FROM c) SELECT s.cx * {_S} + p // {_B} AS sx, s.cy * {_S} + k // 4 * {_B} + p % {_B} AS sy, CAST(0 AS BIGINT) AS layer, s.h AS room, i AS pos, (k * 7 + i) % n AS code FROM s, range(3) t(i) WHERE i <= s.layer"""


def _squares(spark, d):
    return B.squares(_body_files(spark, d), _head_files(spark, d))


@query(_SQUARES)
def S7_S8_cell_squares(spark, d):
    s = _squares(spark, d).filter("error is null")
    return s.select(*(F.col(c).cast("bigint").alias(c) for c in ("sx", "sy", "layer", "room", "pos", "code")))


_MOVES = [{"src": (0, 0), "offset": (100, 0), "size": (50, 1000)}, {"src": (1, 0), "dst": (102, 0)}, {"src": (49, 5000), "dst": (100, 0)}]


@query(f"""WITH {_C}, m AS (SELECT cx, cy, cx + 100 AS tx, cy AS ty, 0 AS ord FROM (SELECT DISTINCT cx, cy FROM c WHERE cy < 1000) UNION ALL SELECT 1, 0, 102, 0, 1), t AS (SELECT tx, ty, arg_max(cx, ord) AS cx, arg_max(cy, ord) AS cy FROM m GROUP BY tx, ty),
  s AS (SELECT *, k % 4 * 16 + w AS p FROM c) SELECT tx AS cx, ty AS cy, tx * {_S.replace('cx', 's.cx')} + p // {_B.replace('cx', 's.cx')} AS sx, ty * {_S.replace('cx', 's.cx')} + s.k // 4 * {_B.replace('cx', 's.cx')} + p % {_B.replace('cx', 's.cx')} AS sy, CAST(0 AS BIGINT) AS layer, s.h AS room, i AS pos, trim(e.name) AS tile
  FROM t JOIN s ON s.cx = t.cx AND s.cy = t.cy JOIN range(3) r(i) ON i <= s.layer JOIN c e ON e.cx = s.cx AND e.cy = s.cy AND e.k = (s.k * 7 + i) % s.n""")
def job_test_map(spark, d):
    """Cells of both formats decoded, written anew with dictionaries of their own names, moved, and decoded again."""
    heads = reliable(B.headers(_head_files(spark, d)))  # each step is used more than once
    files = reliable(E.encoded(reliable(B.named(_squares(spark, d), heads)), heads))
    files = reliable(E.moved(files, E.moves(spark, _MOVES)))
    bodies, heads = files.filter("name like 'world%'"), files.filter("name like '%lotheader'")
    s = B.named(B.squares(bodies, heads), B.headers(heads))
    return s.select(*(F.col(c).cast("bigint").alias(c) for c in ("cx", "cy", "sx", "sy", "layer", "room", "pos")), "tile")


@query(f"""WITH {_C}, f AS (SELECT *, cx || '_' || cy AS u FROM c) SELECT '/maps/' || u || '.pzby' AS path, k // 8 AS x, k % 8 AS y, CASE WHEN k % 3 = 0 THEN w END AS attribute, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS tile FROM f WHERE k % 3 = 0
  UNION ALL SELECT '/maps/' || f.u || '.pzby', f.k // 8, f.k % 8, NULL, i, trim(g.name) FROM f JOIN range(2) t(i) ON true JOIN f g ON g.u = f.u AND g.k = CASE i WHEN 0 THEN f.k ELSE 0 END WHERE f.k % 3 = 2""")
def S9_prefabs(spark, d):
    items = F.col("items")
    head = F.concat(F.hex(F.lit("PZBY")), le(1), le(F.size(items)), _all(items, lambda r: _line(r["name"])), le(1), le(1), le(1), le(0), le(0))
    attributes = _runs(F.filter(items, lambda r: r["k"] % 3 == 0), lambda r: r["k"], lambda r: F.concat(le(2), le(r["w"])), 64)
    tiles = _runs(F.filter(items, lambda r: r["k"] % 3 == 2), lambda r: r["k"], lambda r: F.concat(le(3), le(r["k"]), le(0)), 64)
    p = B.prefabs(_file(_cells(spark, d), "%d_%d.pzby", F.concat(head, le(F.length(head) / 2 + 8), le(0), attributes, tiles)))
    return p.filter("error is null").select("path", *(F.col(c).cast("bigint").alias(c) for c in ("x", "y", "attribute", "pos")), "tile")


@query(f"""WITH {_C} SELECT '/maps/' || cx || '_' || cy || '.pack' AS path, 'page' || cx AS page, CAST(cy % 2 AS BIGINT) AS has_alpha, name, x, y, w, h, id % 7 AS ox, CAST(-3 AS BIGINT) AS oy, CASE WHEN k = 0 THEN 'PNG of ' || cx END AS png FROM c""")
def S10_packs(spark, d):
    items, new = F.col("items"), F.col("version") == 1
    page, png = F.concat(F.lit("page"), F.col("cx")), F.concat(F.lit("PNG of "), F.col("cx"))
    textures = _all(items, lambda r: F.concat(sized(r["name"]), *(le(r[c]) for c in "xywh"), le(r["id"] % 7), le(-3), le(r["w"]), le(r["h"])))
    content = F.concat(F.when(new, F.concat(F.hex(F.lit("PZPK")), le(1))).otherwise(""), le(1), sized(page), le(F.size(items)), le(F.col("cy") % 2), textures, F.when(new, sized(png)).otherwise(F.concat(F.hex(png), F.lit("EFBEADDE"))))
    p = B.packs(_file(_cells(spark, d), "%d_%d.pack", content)).filter("error is null")
    return p.select("path", "page", F.col("has_alpha").cast("bigint").alias("has_alpha"), "name", *(F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w", "h", "ox", "oy")), F.decode("png", "utf-8").alias("png"))


@query("""SELECT x AS wx, y AS wy, id AS id, 150 + id % 100 AS version, CASE WHEN id % 100 <= 45 THEN 'B41' ELSE 'B42' END AS format FROM v_rects WHERE id % 4 < 3""")
def S16_S17_S24_save_blocks(spark, d):
    """Three layouts of chunk paths, and other files, which drop out; the version decides the format."""
    kind = F.col("id") % 4
    path = F.when(kind == 0, F.format_string("s/map/%d/%d.bin", "x", "y")).when(kind == 1, F.format_string("s/map/map_%d_%d.bin", "x", "y")).when(kind == 2, F.format_string("s/map_%d_%d.bin", "x", "y")).otherwise(F.format_string("s/zpop_%d_%d.bin", "x", "y"))
    content = F.unhex(F.concat(F.lit("01"), F.lpad(F.hex(150 + F.col("id") % 100), 8, "0"), F.lit("FFFF")))
    found = B.save_blocks(view(spark, d, "v_rects").select("id", path.alias("path"), content.alias("content")))
    return found.select(F.col("wx").cast("bigint").alias("wx"), F.col("wy").cast("bigint").alias("wy"), "id", B.save_version().alias("v")).select("wx", "wy", "id", "v.*")


def _zone_files(spark, d):
    one = lambda r: F.concat(F.lit('{ type = "'), r["type"], F.lit('", name = "'), r["name"], F.lit('", z = '), r["layer"], F.lit(", "), F.when(r["k"] % 2 == 0, F.concat(*(x for n, c in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h")) for x in (F.lit(f"{n} = "), r[c], F.lit(", "))))).otherwise(F.concat(F.lit('geometry = "polygon", points = { '), F.concat_ws(", ", r["x"], r["y"], r["x"] + r["w"] * 2, r["y"], r["x"] + r["w"] * 2, r["y"] + r["h"], r["x"] + r["w"], r["y"] + r["h"], r["x"] + r["w"], r["y"] + r["h"] * 2, r["x"], r["y"] + r["h"] * 2), F.lit(" }, "))), F.lit('properties = { part = "'), r["id"], F.lit('" } }, -- one\n'))
    return _file(_cells(spark, d), "%d_%d.lua", F.hex(F.concat(F.lit("-- zones\nother = { 1 }\nobjects = {\n"), _all("items", one), F.lit("}\n"))))


@query(f"""WITH {_C} SELECT '/maps/' || cx || '_' || cy || '.lua' AS path, k AS ord, type, name, layer AS z, CASE WHEN k % 2 = 0 THEN x END AS x, CASE WHEN k % 2 = 0 THEN h END AS height, CASE WHEN k % 2 = 1 THEN 'polygon' END AS geometry, CASE WHEN k % 2 = 1 THEN CAST(6 * x + 6 * w AS DOUBLE) END AS sum_x, CAST(id AS VARCHAR) AS part FROM c""")
def S11_S12_zone_tables(spark, d):
    z = S.zones(_zone_files(spark, d)).filter("error is null")
    xs = F.aggregate(F.filter("points", lambda p, i: i % 2 == 0), F.lit(0.0), lambda s, p: s + p)
    return z.select("path", "ord", "type", "name", "z", "x", "height", "geometry", xs.alias("sum_x"), F.col("properties")["part"].alias("part"))


@query(f"""WITH {_C}, s AS (SELECT type, id, name, layer, x + i AS sx, y + j AS sy FROM c, range(24) a(i), range(18) b(j) WHERE layer IN (0, 1) AND type <> 'Brand#11' AND CASE WHEN k % 2 = 0 THEN i < w AND j < h ELSE i < 2 * w AND j < 2 * h AND NOT (i >= w AND j >= h) END)
  SELECT layer, name, CAST(count(*) AS BIGINT) AS squares, CAST(sum(sx) AS BIGINT) AS sum_x, CAST(sum(sy) AS BIGINT) AS sum_y FROM s GROUP BY layer, name""")
def job_objects(spark, d):
    """Rectangles and L-shaped polygons as marks; the squares of their rectangles. A skipped type drops out."""
    colours = {f"Brand#{i}": "skip" if i == 11 else "green" for i in range(1, 26)}
    m = JOBS["objects"](S.zones(_zone_files(spark, d)).filter("error is null"), colours, (0, 2))
    from ..functions.geometry import squares_of

    q = m.select("layer", "name", F.explode("rects").alias("q")).select("layer", "name", F.explode(squares_of("q.x", "q.y", "q.width", "q.height")).alias("p"))
    return q.groupBy("layer", "name").agg(F.count("*").alias("squares"), F.sum("p.x").cast("bigint").alias("sum_x"), F.sum("p.y").cast("bigint").alias("sum_y"))


@query("""SELECT 'st ' || id AS name, CAST(id % 16 AS BIGINT) AS width, x0, y0, x1, y1, CAST(CASE WHEN greatest(abs(x1 - x0), abs(y1 - y0)) > 512 OR id % 16 > 12 THEN 0 WHEN greatest(abs(x1 - x0), abs(y1 - y0)) > 256 OR id % 16 > 8 THEN 1 ELSE 2 END AS BIGINT) AS visible_zoom_level FROM v_segments""")
def S13_job_streets(spark, d):
    """Streets written as XML below the shared folder, read back and made into marks."""
    path = f"{shared_dir(spark).rstrip('/')}/streets-{uuid.uuid4().hex}"
    point = lambda i: F.concat(F.lit('<point x="'), F.col(f"x{i}"), F.lit('" y="'), F.col(f"y{i}"), F.lit('"/>'))
    street = F.concat(F.lit('<street name="st '), F.col("id"), F.lit('" width="'), F.col("id") % 16, F.lit('"><points>'), point(0), point(1), F.lit("</points></street>"))
    documents = view(spark, d, "v_segments").groupBy(F.expr("id div 4096").alias("doc")).agg(F.array_join(F.collect_list(street), "").alias("all"))  # 4096 streets at most
    documents.select(F.concat(F.lit("<streets>"), "all", F.lit("</streets>"))).write.option("maxRecordsPerFile", 1).text(path)
    m = JOBS["streets"](S.read_streets(spark, path))
    ends = [F.col("points")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in "xy"]
    return m.select("name", F.col("width").cast("bigint").alias("width"), *ends, F.col("visible_zoom_level").cast("bigint").alias("visible_zoom_level"))


def _raster_files(spark, d):
    """An image of 8 by 8 grey pixels for each cell; places without an item are black."""
    grey = _all("items", lambda r: F.concat(F.repeat(F.lpad(F.hex(F.floor(r["id"] / 3) % 5), 2, "0"), 3), F.lit("FF")))
    cells = _cells(spark, d).select("cx", "cy", F.unhex(F.rpad(grey, 512, "000000FF")).alias("rgba"))
    return cells.select(F.format_string("/maps/biomemap_%d_%d.png", "cx", "cy").alias("path"), to_png(F.lit(8), "rgba").alias("content"))


@query(f"WITH {_C}, g AS (SELECT cx, cy, i FROM (SELECT DISTINCT cx, cy FROM c), range(64) t(i)) SELECT g.cx, g.cy, i % 8 AS x, i // 8 AS y, CAST(coalesce(id // 3 % 5, 0) AS BIGINT) AS pixel FROM g LEFT JOIN c ON c.cx = g.cx AND c.cy = g.cy AND c.k = g.i")
def S14_raster_pixels(spark, d):
    p = S.rasters(_raster_files(spark, d)).filter("error is null")
    return p.select(*(F.col(c).cast("bigint").alias(c) for c in ("cx", "cy", "x", "y", "pixel")))


@query(f"""WITH {_C}, g AS (SELECT cx, cy, i FROM (SELECT DISTINCT cx, cy FROM c), range(64) t(i)), p AS (SELECT g.cx, g.cy, i % 8 AS x, i // 8 AS y, coalesce(id // 3 % 5, 0) AS pixel FROM g LEFT JOIN c ON c.cx = g.cx AND c.cy = g.cy AND c.k = g.i),
  r AS (SELECT *, x - row_number() OVER (PARTITION BY cx, cy, y, pixel ORDER BY x) AS run FROM p) SELECT min(x) + cx * 256 AS x, y + cy * 256 AS y, CAST(count(*) AS BIGINT) AS w, CASE pixel WHEN 1 THEN 'forest' ELSE 'farm' END AS zone FROM r WHERE pixel IN (1, 2) GROUP BY cx, cy, y, pixel, run""")
def job_foraging(spark, d):
    """Runs of zones of decoded images; pixels without a zone, skipped zones and zones without a colour end a run."""
    zones = spark.sql("SELECT * FROM VALUES (1, 'forest'), (2, 'farm'), (3, 'town'), (4, 'other') AS t(pixel, zone)")
    runs = JOBS["foraging"](S.rasters(_raster_files(spark, d)).filter("error is null").drop("error"), zones, {"forest": "green", "farm": "yellow", "town": "skip"})
    return runs.select(*(F.col(c).cast("bigint").alias(c) for c in ("x", "y", "w")), "zone")


@query(f"""WITH {_C}, q AS (SELECT *, {_S} AS cell, {_B} AS side FROM c),
  s AS (SELECT c.cx * c.cell + (c.k % 4 * 16 + c.w) // c.side AS x, c.cy * c.cell + c.k // 4 * c.side + (c.k % 4 * 16 + c.w) % c.side AS y, trim(t.name) AS name FROM q c JOIN range(3) r(i) ON r.i <= c.layer JOIN c t ON t.cx = c.cx AND t.cy = c.cy AND t.k = (c.k * 7 + r.i) % c.n)
  SELECT x, y, name, CAST(CASE WHEN count(*) OVER () >= 128 THEN 2 ELSE 1 END AS BIGINT) AS visible_zoom_level FROM s WHERE name IN ('blue ring', 'cold gear', 'cold widget')""")
def job_locate(spark, d):
    """Squares of decoded cells with wanted tiles; only cells whose dictionaries have one are scanned."""
    heads = B.headers(_head_files(spark, d))
    found = JOBS["locate"](B.named(_squares(spark, d), heads), heads, ["blue ring", "cold gear", "cold widget"])
    return found.select(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "name", F.col("visible_zoom_level").cast("bigint").alias("visible_zoom_level"))


@query(f"""WITH {_C}, s AS (SELECT type, '/maps/' || cx || '_' || cy || '.lua' AS path, k, x + i AS sx, y + j AS sy FROM c, range(24) a(i), range(18) b(j) WHERE layer = 0 AND type <> 'Brand#11' AND CASE WHEN k % 2 = 0 THEN i < w AND j < h ELSE i < 2 * w AND j < 2 * h AND NOT (i >= w AND j >= h) END),
  f AS (SELECT sx, sy, arg_min(type, path || printf('%06d', k)) AS zone FROM s GROUP BY sx, sy) SELECT zone, CAST(count(*) AS BIGINT) AS squares, CAST(sum(sx) AS BIGINT) AS sum_x, CAST(sum(sy) AS BIGINT) AS sum_y FROM f GROUP BY zone""")
def job_foraging_b41(spark, d):
    """Foraging zones of the older format: each square belongs to the first zone that has it."""
    colours = {f"Brand#{i}": "skip" if i == 11 else "green" for i in range(1, 56)}
    r = JOBS["foraging_b41"](S.zones(_zone_files(spark, d)).filter("error is null"), colours)
    return r.groupBy("zone").agg(F.sum("h").cast("bigint").alias("squares"), F.sum(F.col("x") * F.col("h")).cast("bigint").alias("sum_x"), F.sum(F.expr("(y + y + h - 1) * h div 2")).cast("bigint").alias("sum_y"))
