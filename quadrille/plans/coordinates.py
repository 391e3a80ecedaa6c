"""Queries over coordinates and scalar functions (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import geometry as G
from ..functions import values as V
from .catalogue import query
from .views import view

DIV = "CAST(floor({a} / {n}.0) AS BIGINT)"


def _div(a: str, n: int) -> str:
    return f"CAST(floor(({a}) / {n}.0) AS BIGINT)"


@query(f"SELECT DISTINCT x, y, {_div('x', 256)} AS cx, x - 256 * {_div('x', 256)} AS sub_x, {_div('y', 8)} AS bx, y - 8 * {_div('y', 8)} AS in_block FROM v_points")
def P1_floor_division(spark, d):
    p = view(spark, d, "v_points").select("x", "y").distinct()
    return p.select("x", "y", C.floor_div("x", 256).alias("cx"), C.floor_mod("x", 256).alias("sub_x"), C.floor_div("y", 8).alias("bx"), C.floor_mod("y", 8).alias("in_block"))


@query("""SELECT DISTINCT x, y, x - y AS gx, x + y AS gy, CASE WHEN (x + y) % 2 = 0 THEN CAST(floor((x + y) / 2.0) AS BIGINT) END AS sx, CASE WHEN (x + y) % 2 = 0 THEN CAST(floor((y - x) / 2.0) AS BIGINT) END AS sy FROM v_points""")
def P2_grid(spark, d):
    p = view(spark, d, "v_points").select("x", "y").distinct()
    gx, gy = C.to_grid("x", "y")
    sx, sy = C.from_grid("x", "y")
    return p.select("x", "y", gx.alias("gx"), gy.alias("gy"), sx.alias("sx"), sy.alias("sy"))


@query("SELECT DISTINCT x, y, layer, x * 16 - 5 AS gx, y * 32 + 3 + layer * 6 AS gy FROM v_points")
def P3_tile_to_grid(spark, d):
    gx, gy = C.tile_to_grid("x", "y", "layer", origin=(-5, 3))
    return view(spark, d, "v_points").select("x", "y", "layer").distinct().select("x", "y", "layer", gx.alias("gx"), gy.alias("gy"))


@query("SELECT DISTINCT x, y, x * 64 AS px, y * 32 AS py FROM v_points")
def P4_grid_to_pixel(spark, d):
    px, py = C.grid_to_pixel("x", "y")
    return view(spark, d, "v_points").select("x", "y").distinct().select("x", "y", px.alias("px"), py.alias("py"))


@query("SELECT DISTINCT x, y, x - 3 AS cx, y + 1 AS cy, x * 512 AS px, y * 512 AS py FROM v_points")
def P5_tile_to_cell(spark, d):
    cx, cy = C.tile_to_cell("x", "y", 256, origin=(-600, 300))
    return view(spark, d, "v_points").select("x", "y").distinct().select("x", "y", cx.alias("cx"), cy.alias("cy"), (F.col("x") * 512).alias("px"), (F.col("y") * 512).alias("py"))


@query("SELECT DISTINCT x, layer, CASE WHEN layer <= 0 THEN x ELSE CAST(floor(x / CAST(layer * 10 AS DOUBLE)) AS BIGINT) * layer * 10 END AS origin FROM v_points")
def P6_align(spark, d):
    return view(spark, d, "v_points").select("x", "layer").distinct().select("x", "layer", C.align("x", F.greatest(F.col("layer"), F.lit(0)) * 10).alias("origin"))


@query("""SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS n, CASE id % 3 WHEN 0 THEN x || ',' || y || ',1,1' WHEN 1 THEN x || ',' || y || ',1,1;' || x || ',' || y || ',' || w || ',' || h ELSE '' END AS rects FROM v_rects""")
def P7_normal_rects(spark, d):
    r = view(spark, d, "v_rects")
    pair, four, three = F.array("x", "y"), F.array("x", "y", "w", "h"), F.array("x", "y", "w")
    raw = F.when(F.col("id") % 3 == 0, F.array(pair)).when(F.col("id") % 3 == 1, F.array(pair, four)).otherwise(F.array(three))
    rects = C.normal_rects(raw)
    return r.select("id", F.size(rects).cast("bigint").alias("n"), F.array_join(F.transform(rects, lambda q: F.array_join(q.cast("array<string>"), ",")), ";").alias("rects"))


@query("""WITH RECURSIVE s(id, k, w, h) AS (SELECT id, CAST(0 AS BIGINT), w * 100, h * 77 FROM v_rects UNION ALL SELECT id, k + 1, (w + 1) // 2, (h + 1) // 2 FROM s WHERE w > 1 OR h > 1) SELECT id, k, w, h FROM s""")
def P8_pyramid_sizes(spark, d):
    r = view(spark, d, "v_rects").select("id", F.posexplode(C.pyramid_sizes(F.col("w") * 100, F.col("h") * 77)).alias("k", "s"))
    return r.select("id", F.col("k").cast("bigint").alias("k"), F.col("s.w").cast("bigint").alias("w"), F.col("s.h").cast("bigint").alias("h"))


@query("""SELECT DISTINCT x, y, CAST(list_sum(list_transform(range(0, 12), lambda i: (((x + 512) >> i) & 1) * (1 << (2 * i)) + (((y + 512) >> i) & 1) * (1 << (2 * i + 1)))) AS BIGINT) AS z FROM v_points""")
def P9_morton(spark, d):
    return view(spark, d, "v_points").select("x", "y").distinct().select("x", "y", C.morton(F.col("x") + 512, F.col("y") + 512).alias("z"))


@query(f"""SELECT DISTINCT x AS tx, y AS ty, {_div('x', 2)} AS px, {_div('y', 2)} AS py, {_div('x', 8)} AS px3, 2 * x + dx AS kx, 2 * y + dy AS ky FROM v_points, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) k(dx, dy) WHERE layer = 0""")
def P10_parent_children(spark, d):
    p = view(spark, d, "v_points").filter("layer = 0").select(F.col("x").alias("tx"), F.col("y").alias("ty")).distinct()
    return p.select("tx", "ty", C.parent("tx").alias("px"), C.parent("ty").alias("py"), C.parent("tx", 3).alias("px3"), F.explode(C.children("tx", "ty")).alias("k")).select("tx", "ty", "px", "py", "px3", F.col("k.tx").alias("kx"), F.col("k.ty").alias("ky"))


@query("""SELECT id, z, CASE WHEN z >= 128 THEN (z - 128) * 2 ELSE 0 END AS r, CASE WHEN z >= 128 THEN 255 - (z - 128) * 2 ELSE z * 2 END AS g, CASE WHEN z >= 128 THEN 0 ELSE 255 - z * 2 END AS b,
  printf('#%02x%02x%02x', CASE WHEN z >= 128 THEN (z - 128) * 2 ELSE 0 END, CASE WHEN z >= 128 THEN 255 - (z - 128) * 2 ELSE z * 2 END, CASE WHEN z >= 128 THEN 0 ELSE 255 - z * 2 END) AS css FROM v_heat""")
def P11_heat_colour(spark, d):
    r, g, b = V.heat("z")
    return view(spark, d, "v_heat").select("id", "z", *(c.cast("bigint").alias(n) for c, n in zip((r, g, b), "rgb", strict=True)), V.css(r, g, b).alias("css"))


_NAMES = ["red", "skip", "nosuch", "Lime", "orange"]


@query("""SELECT id, CASE id % 5 WHEN 0 THEN '#ff000080' WHEN 2 THEN '#80808080' WHEN 3 THEN '#00ff0080' WHEN 4 THEN '#ffa50080' END AS colour FROM v_heat""")
def P12_colour_name(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("id") % 5 + 1).cast("int"))
    return view(spark, d, "v_heat").select("id", V.colour(name, "gray", 128).alias("colour"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'lime' WHEN 1 THEN 'magenta' WHEN 2 THEN 'silver' ELSE 'cyan' END AS colour FROM v_heat""")
def P13_room_colour(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("gym", "toolstore", "empty", "hall"))), (F.col("id") % 4 + 1).cast("int"))
    return view(spark, d, "v_heat").select("id", V.lookup(name, V.ROOM_COLOURS, V.ROOM_DEFAULT).alias("colour"))


@query("""SELECT id, CAST(CASE WHEN greatest(abs(x1 - x0), abs(y1 - y0)) * 2 > 512 OR id % 16 > 12 THEN 0 WHEN greatest(abs(x1 - x0), abs(y1 - y0)) * 2 > 256 OR id % 16 > 8 THEN 1 ELSE 2 END AS BIGINT) AS class FROM v_segments""")
def P14_street_class(spark, d):
    s = view(spark, d, "v_segments")
    points = F.array(F.struct((F.col("x0") * 2).alias("x"), (F.col("y0") * 2).alias("y")), F.struct((F.col("x1") * 2).alias("x"), (F.col("y1") * 2).alias("y")))
    return s.select("id", V.street_class(points, F.col("id") % 16).cast("bigint").alias("class"))


_TILES = ("blends_natural_01_5", "vegetation_farm_1", "walls_1", "_railroad_3", "f_trees_1", "x_street_9", "blends_natural_02_6", "vegetation_9", "location_2", "blends_natural_01_33")


def _rule_sql(order: list[tuple[int, int | None, str, str]]) -> str:
    whens = []
    for begin, end, pattern, colour in order:
        part = f"tiles[{begin + 1}:{end if end else 10}]"
        whens.append(f"WHEN len(list_filter({part}, lambda t: regexp_matches(t, '{pattern}'))) > 0 THEN '{colour}'")
    return "CASE " + " ".join(whens) + " END"


_RULES = [(b, e, p, "#{:02x}{:02x}{:02x}".format(*c)) for b, e, p, c in V.GROUND_RULES]
_UPPER = [(b, e, p, "#{:02x}{:02x}{:02x}".format(*c)) for b, e, p, c in V.UPPER_RULES]


@query(f"""SELECT id, layer, CASE WHEN layer = 0 THEN {_rule_sql(_RULES)} ELSE {_rule_sql(_UPPER)} END AS colour FROM (
  SELECT id, layer, [t[1 + id % 10], t[1 + (id // 10) % 10], t[1 + (id * 7) % 10]] AS tiles FROM (SELECT id, layer, [{', '.join(f"'{t}'" for t in _TILES)}] AS t FROM v_rects))""")
def P15_ground_rules(spark, d):
    t = F.array(*map(F.lit, _TILES))
    at = lambda e: F.element_at(t, (e + 1).cast("int"))
    tiles = F.array(at(F.col("id") % 10), at(F.expr("id div 10") % 10), at(F.col("id") * 7 % 10))
    return view(spark, d, "v_rects").select("id", "layer", V.ground_colour(tiles, "layer").alias("colour"))


@query("""SELECT id, CASE id % 3 WHEN 0 THEN type || 'cold' || chr(10) || 'storage' WHEN 1 THEN 'tool' || chr(10) || 'store' ELSE substr(type, 1, CAST(floor(length(type) / 2.0) AS BIGINT)) || chr(10) || substr(type, CAST(floor(length(type) / 2.0) AS BIGINT) + 1) END AS label FROM v_rects""")
def P16_label_break(spark, d):
    text = F.when(F.col("id") % 3 == 0, F.concat("type", F.lit("coldstorage"))).when(F.col("id") % 3 == 1, "toolstore").otherwise(F.col("type"))
    return view(spark, d, "v_rects").select("id", V.broken_label(text).alias("label"))


@query("""SELECT id, CAST(2 AS BIGINT) AS n, CAST(x + w AS DOUBLE) AS sum_x, CAST(y + h AS DOUBLE) AS sum_y FROM v_rects""")
def P17_array_to_points(spark, d):
    p = G.array_to_points(F.array(*(F.col(c).cast("double") for c in ("x", "y", "w", "h", "x"))))
    total = lambda a: F.aggregate(p, F.lit(0.0), lambda s, q: s + q[a])
    return view(spark, d, "v_rects").select("id", F.size(p).cast("bigint").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))


@query("SELECT type, CAST(min(x) AS BIGINT) AS x1, CAST(min(y) AS BIGINT) AS y1, CAST(max(x + w) AS BIGINT) AS x2, CAST(max(y + h) AS BIGINT) AS y2, CAST(sum(w * h) AS BIGINT) AS area FROM v_rects GROUP BY type")
def P18_bounds(spark, d):
    r = view(spark, d, "v_rects")
    return r.groupBy("type").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"), F.sum(F.col("w") * F.col("h")).alias("area"))


@query("""SELECT id, CAST(trunc(least(x0, x1) + 0.25) AS BIGINT) AS x, CAST(trunc(least(y0, y1) + 0.25) AS BIGINT) AS y, CAST(trunc(greatest(x0, x1) + 0.75) AS BIGINT) + 1 - CAST(trunc(least(x0, x1) + 0.25) AS BIGINT) AS w, CAST(trunc(greatest(y0, y1) + 0.75) AS BIGINT) + 1 - CAST(trunc(least(y0, y1) + 0.25) AS BIGINT) AS h FROM v_segments""")
def P19_extent(spark, d):
    points = F.array(*(F.struct((F.col(f"x{i}") + 0.25).alias("x"), (F.col(f"y{i}") + 0.25).alias("y")) for i in (0, 1)))
    return view(spark, d, "v_segments").select("id", G.extent(points).alias("b")).select("id", "b.*")


@query("SELECT id, x AS x1, x + w AS x2, y AS y1, y + h AS y2, x - y - h AS d1, x + w - y AS d2, x + y AS s1, x + w + y + h AS s2 FROM v_rects")
def P20_mark_boxes(spark, d):
    from ..operators.marks import boxed

    return boxed(view(spark, d, "v_rects")).select("id", "x1", "x2", "y1", "y2", "d1", "d2", "s1", "s2")


@query("""SELECT type, round(sum((x + w / 2.0) * w * h) / sum(w * h), 6) AS cx, round(sum((y + h / 2.0) * w * h) / sum(w * h), 6) AS cy, CAST(min(x * 1000 + y) AS BIGINT) AS top_key FROM v_rects GROUP BY type""")
def P21_centroid_top(spark, d):
    r = view(spark, d, "v_rects")
    area = F.col("w") * F.col("h")
    mean = lambda v, s: F.round(F.sum((F.col(v) + F.col(s) / 2.0) * area) / F.sum(area), 6)
    top = F.min(F.struct("x", "y"))
    return r.groupBy("type").agg(mean("x", "w").alias("cx"), mean("y", "h").alias("cy"), (top["x"] * 1000 + top["y"]).alias("top_key"))


@query("SELECT id, layer, x - 3 * layer AS x, y - 3 * layer AS y FROM v_rects")
def P22_shift_points(spark, d):
    return view(spark, d, "v_rects").select("id", "layer", C.shift_points(F.array(F.struct("x", "y")), "layer")[0].alias("p")).select("id", "layer", "p.x", "p.y")


@query("""SELECT id, (x - y) * 4.0 AS px, (x + y) * 2.0 - 12.0 * layer AS py, x AS sx, y AS sy, x * 8.0 AS tx, y * 8.0 AS ty FROM v_rects""")
def P23_canvas(spark, d):
    r = view(spark, d, "v_rects")
    px, py = C.square_to_canvas("x", "y", "layer", 8.0, "iso")
    tx, ty = C.square_to_canvas("x", "y", "layer", 8.0, "top")
    back = C.canvas_to_square("px", "py", "layer", 8.0, "iso")
    out = r.select("id", "layer", px.alias("px"), py.alias("py"), tx.alias("tx"), ty.alias("ty"))
    return out.select("id", "px", "py", *(c.cast("bigint").alias(n) for c, n in zip(back, ("sx", "sy"), strict=True)), "tx", "ty")


@query(f"SELECT DISTINCT x, {_div('x * 256', 8)} AS cell_to_block, {_div('x * 1', 256)} AS square_to_cell, {_div('x * 8', 256)} AS block_to_cell FROM v_points")
def P24_units(spark, d):
    return view(spark, d, "v_points").select("x").distinct().select("x", C.convert_unit("x", 256, 8).alias("cell_to_block"), C.convert_unit("x", 1, 256).alias("square_to_cell"), C.convert_unit("x", 8, 256).alias("block_to_cell"))


@query("SELECT id, CAST(CASE WHEN z >= 32 THEN 3 WHEN z >= 8 THEN 2 WHEN z >= 1 THEN 1 ELSE 0 END AS BIGINT) AS iso, CAST(CASE WHEN z >= 16 THEN 3 WHEN z >= 8 THEN 2 WHEN z >= 1 THEN 1 ELSE 0 END AS BIGINT) AS top FROM v_heat")
def P25_zoom_level(spark, d):
    return view(spark, d, "v_heat").select("id", *(C.zoom_level("z", v).cast("bigint").alias(v) for v in ("iso", "top")))


@query("SELECT id, (z * 0.2126 + (255 - z) * 0.7152 + (z * 3 % 256) * 0.0722) > 128 AS light FROM v_heat")
def P26_is_light(spark, d):
    return view(spark, d, "v_heat").select("id", V.is_light("z", 255 - F.col("z"), F.col("z") * 3 % 256).alias("light"))


@query("SELECT id, name || ' at ' || x || ', again {name}' AS text FROM v_rects")
def P27_template(spark, d):
    return view(spark, d, "v_rects").select("id", V.filled(F.lit("{name} at {0}, again {name}"), {"name": F.col("name"), "0": F.col("x")}).alias("text"))


@query("SELECT id, regexp_replace(name || ' #1/2.x-y', '[^-a-zA-Z0-9_.]', '_', 'g') AS folder FROM v_rects")
def P28_folder_name(spark, d):
    return view(spark, d, "v_rects").select("id", V.folder_name(F.concat("name", F.lit(" #1/2.x-y"))).alias("folder"))


@query("""SELECT id, CASE WHEN id % 2 = 0 AND id % 5 <> 0 THEN 'a' || id WHEN id % 3 = 0 THEN 'b' WHEN id % 7 = 0 THEN 'c' ELSE 'd' END AS loose, CASE WHEN id % 2 = 0 THEN CASE WHEN id % 5 = 0 THEN '0' ELSE 'a' || id END WHEN id % 3 = 0 THEN 'b' WHEN id % 7 = 0 THEN 'c' ELSE 'd' END AS strict FROM v_rects""")
def P29_scoped_option(spark, d):
    c = F.col("id")
    pairs = F.array(F.when(c % 2 == 0, F.struct(F.lit("[m](r)").alias("k"), F.when(c % 5 == 0, "0").otherwise(F.concat(F.lit("a"), c.cast("string"))).alias("v"))), F.when(c % 3 == 0, F.struct(F.lit("(r)").alias("k"), F.lit("b").alias("v"))), F.when(c % 7 == 0, F.struct(F.lit("[m]").alias("k"), F.lit("c").alias("v"))), F.struct(F.lit("").alias("k"), F.lit("d").alias("v")))
    options = F.map_from_entries(F.array_compact(pairs))
    return view(spark, d, "v_rects").select("id", V.scoped_option(options, "m", "r").alias("loose"), V.scoped_option(options, "m", "r", strict=True).alias("strict"))


@query("SELECT id, layer * 262144 + 12 * 512 + id % 12 AS sprite FROM v_rects")
def P30_sprite_id(spark, d):
    return view(spark, d, "v_rects").select("id", V.jumbo_sprite("layer", F.lit(12), F.col("id") % 12).cast("bigint").alias("sprite"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def P32_digests(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""WITH t AS (SELECT conv_id, lang, arg_min(text, turn) AS text FROM v_texts GROUP BY conv_id, lang)
  SELECT conv_id, string_agg(lang || ':' || text, '&&' ORDER BY lang || ':' || text) AS packed, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY conv_id""")
def P33_packed(spark, d):
    """Over whole texts."""
    t = view(spark, d, "v_texts").groupBy("conv_id", "lang").agg(F.min_by("text", "turn").alias("text"))
    m = t.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("m")).select("conv_id", V.packed("m").alias("packed"))
    return m.select("conv_id", "packed", F.size(V.unpacked("packed")).cast("bigint").alias("n"))


@query("""SELECT conv_id, arg_min(text, turn) FILTER (WHERE lang = 'user') AS "user", arg_min(text, turn) FILTER (WHERE lang = 'assistant') AS assistant, arg_min(text, turn) FILTER (WHERE lang = 'system') AS "system" FROM v_texts GROUP BY conv_id""")
def P34_wide_long(spark, d):
    """Over whole texts."""
    from ..operators.relational import long_options, wide_options

    langs = ["user", "assistant", "system"]
    t = view(spark, d, "v_texts").groupBy("conv_id", "lang").agg(F.min_by("text", "turn").alias("text"))
    wide = wide_options(t, ["conv_id"], langs).select("conv_id", *(F.col(x).alias(f"name_{x}") for x in langs))
    return wide_options(long_options(wide, ["conv_id"], "name"), ["conv_id"], langs)


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'a=1;b=9' ELSE 'a=1;b=2' END || ';c=' || w AS merged FROM v_rects")
def P35_merge(spark, d):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    new = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("c"), F.col("w").cast("string"), F.lit("b"), F.lit("9"))).otherwise(F.create_map(F.lit("c"), F.col("w").cast("string")))
    m = F.array_sort(F.transform(F.map_entries(V.merged(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return view(spark, d, "v_rects").select("id", F.array_join(m, ";").alias("merged"))


@query("""SELECT id, array_to_string(list_filter([CASE WHEN w IS DISTINCT FROM h THEN 'size' END, CASE WHEN nullif(x % 5, 0) IS DISTINCT FROM nullif(y % 5, 0) THEN 'place' END], lambda v: v IS NOT NULL), ',') AS changed FROM v_rects""")
def P36_differing(spark, d):
    old = {"size": F.col("w"), "place": F.nullif(F.col("x") % 5, F.lit(0))}
    new = {"size": F.col("h"), "place": F.nullif(F.col("y") % 5, F.lit(0))}
    return view(spark, d, "v_rects").select("id", F.array_join(V.differing(old, new), ",").alias("changed"))


@query("SELECT CAST(-1 AS BIGINT) AS a_left, CAST(-7 AS BIGINT) AS a_top, CAST(1 AS BIGINT) AS a_right, CAST(1 AS BIGINT) AS a_bottom, CAST(-3 AS BIGINT) AS b_left, CAST(-63 AS BIGINT) AS b_top, CAST(3 AS BIGINT) AS b_right, CAST(13 AS BIGINT) AS b_bottom")
def P37_margins(spark, d):
    a, b = C.affected_margin(C.render_margin(False)), C.affected_margin(C.render_margin(True), (-2, 8))
    names = [f"{k}_{s}" for k in "ab" for s in ("left", "top", "right", "bottom")]
    return spark.range(1).select(*(F.lit(v).cast("bigint").alias(n) for v, n in zip((*a, *b), names, strict=True)))


@query("""SELECT id, 'a.b=' || CASE WHEN id % 3 = 1 THEN 'x' ELSE '1' END || ';' || CASE WHEN id % 3 = 0 THEN 'a.c.e=9;' ELSE 'a.c.d=2;' END || CASE WHEN id % 3 = 0 THEN 'f=' || w WHEN id % 3 = 1 THEN 'f.g=' || w ELSE 'f=3;h=' || w END AS merged FROM v_rects""")
def P35_deep_merge(spark, d):
    """Branches merge, a value replaces a branch and a branch a value."""
    c, w = F.col("id") % 3, F.col("w").cast("string")
    pairs = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    old = F.when(c == 0, pairs("a.b", "1", "a.c", "2", "f.g", "3")).otherwise(pairs("a.b", "1", "a.c.d", "2", "f", "3"))
    new = F.when(c == 0, pairs("a.c.e", "9", "f", w)).when(c == 1, pairs("f.g", w, "a.b", "x")).otherwise(pairs("h", w))
    m = F.array_sort(F.transform(F.map_entries(V.deep_merged(old, new)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return view(spark, d, "v_rects").select("id", F.array_join(m, ";").alias("merged"))
