"""Queries over the mark store (D, F, T, S23, K15, X8, X9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..operators import marks as M
from .catalogue import query
from .views import view


def _marks(spark, d):
    return M.boxed(view(spark, d, "v_marks"))


@query("SELECT id FROM v_marks WHERE type IN ('Brand#11', 'Brand#12', 'Brand#33') AND layer >= 0 AND layer < 2")
def F1_type_and_layer(spark, d):
    return view(spark, d, "v_marks").filter(F.col("type").isin("Brand#11", "Brand#12", "Brand#33") & (F.col("layer") >= 0) & (F.col("layer") < 2)).select("id")


@query("SELECT DISTINCT type FROM v_marks WHERE type <> 'Brand#11'")
def F2_X14_legend(spark, d):
    return view(spark, d, "v_marks").filter("type <> 'Brand#11'").select("type").distinct()


@query("SELECT DISTINCT x, y FROM v_points p WHERE EXISTS (SELECT 1 FROM v_rects r WHERE p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h)")
def F3_in_any_rect(spark, d):
    """Of all rectangles."""
    from ..operators.joins import point_join

    p = view(spark, d, "v_points").select("x", "y").distinct()
    return point_join(p, view(spark, d, "v_rects")).select("p.x", "p.y").distinct()


@query("SELECT layer, CAST(floor(x / 256.0) AS BIGINT) AS cx, CAST(floor(y / 256.0) AS BIGINT) AS cy FROM v_points GROUP BY 1, 2, 3 HAVING max(v) > 49")
def F5_populated_cells(spark, d):
    cells = view(spark, d, "v_points").groupBy("layer", C.floor_div("x", 256).alias("cx"), C.floor_div("y", 256).alias("cy")).agg(F.max("v").alias("most"))
    return cells.filter("most > 49").drop("most")


@query("SELECT DISTINCT x, y, layer FROM v_points WHERE layer BETWEEN least(-1, 0) AND greatest(2, 0)")
def F6_layer_clamp(spark, d):
    low, high = min(-1, 0), max(2, 0)
    return view(spark, d, "v_points").filter(F.col("layer").between(low, high)).select("x", "y", "layer").distinct()


@query("SELECT id, (x + w >= 40 AND x <= 120 AND y + h >= 30 AND y <= 90) AS closed, (x + w > 40 AND x < 120 AND y + h > 30 AND y < 90) AS open, (x + w - y >= -20 AND x - y - h <= 60 AND x + w + y + h - 6 * layer >= 80 AND x + y - 6 * layer <= 200) AS iso FROM v_marks")
def F7_D6_window_tests(spark, d):
    box = (40, 30, 120, 90)
    return _marks(spark, d).select("id", M.in_window(box).alias("closed"), M.in_window(box, closed=False).alias("open"), M.in_window((-20, 80, 60, 200), iso=True).alias("iso"))


@query("""WITH m AS (SELECT * FROM v_marks WHERE type <> 'Brand#11' AND id <> 7), a AS (SELECT DISTINCT m.id FROM m JOIN v_rects r ON least(m.x + m.w, r.x + r.w) > greatest(m.x, r.x) AND least(m.y + m.h, r.y + r.h) > greatest(m.y, r.y)),
  s AS (SELECT m.id, sum((least(m.x + m.w, g.x + 50) - greatest(m.x, g.x)) * (least(m.y + m.h, g.y + 50) - greatest(m.y, g.y))) AS shared FROM m JOIN (VALUES (0, 0), (50, 0), (100, 100)) g(x, y) ON least(m.x + m.w, g.x + 50) > greatest(m.x, g.x) AND least(m.y + m.h, g.y + 50) > greatest(m.y, g.y) GROUP BY m.id)
  SELECT m.id FROM m JOIN a USING (id) LEFT JOIN s USING (id) WHERE s.shared IS NULL OR s.shared <> m.w * m.h""")
def F8_covers(spark, d):
    m, r = view(spark, d, "v_marks"), view(spark, d, "v_rects")
    exclude = spark.sql("SELECT * FROM VALUES (0L, 0L, 50L, 50L), (50L, 0L, 50L, 50L), (100L, 100L, 50L, 50L) AS t(x, y, w, h)")
    return M.covered(m, r, exclude, ("Brand#11",), (7,)).select("id")


_JSON = """CASE id % 4 WHEN 0 THEN '{"id":"m' || id || '","type":"point","x":' || x || ',"y":' || y || '}' WHEN 1 THEN '{"id":"m' || id || '","type":"area","layer":2,"rects":[{"x":1,"y":2,"width":' || (id % 3) || ',"height":4}]}' WHEN 2 THEN '{"id":"m' || id || '","type":"polyline","points":[{"x":1,"y":2}]}' ELSE '{"id":"m' || id || '","type":"polygon","name":"p","points":[{"x":1,"y":2},{"x":3,"y":4}]}' END"""


@query("SELECT 'm' || id AS id, CASE id % 4 WHEN 0 THEN 'point' WHEN 1 THEN 'area' ELSE 'polygon' END AS type, CASE WHEN id % 4 = 1 THEN 2 ELSE 0 END AS layer, CASE WHEN id % 4 = 3 THEN 'p' ELSE '' END AS name FROM v_marks WHERE id % 4 <> 2 AND NOT (id % 4 = 1 AND id % 3 = 0)")
def S23_F9_load_marks(spark, d):
    lines = view(spark, d, "v_marks").select(F.expr(_JSON).alias("value"))
    return M.load(lines).select("id", "type", "layer", "name")


@query("SELECT type, min(id) AS id FROM v_marks GROUP BY type")
def F12_first_mark(spark, d):
    return view(spark, d, "v_marks").groupBy("type").agg(F.min("id").alias("id"))


@query("SELECT id, layer, visible_zoom_level FROM v_marks WHERE x + w >= 20 AND x <= 150 AND y + h >= 20 AND y <= 160 AND layer = 1 AND visible_zoom_level <= 2")
def D4_J8_viewport(spark, d):
    return M.viewport(_marks(spark, d), (20, 20, 150, 160), 1, 2, limit=0).select("id", "layer", "visible_zoom_level")


@query("SELECT id FROM v_marks WHERE x + w >= 20 AND x <= 150 AND y + h >= 20 AND y <= 160 AND layer = 1 AND visible_zoom_level <= 2 ORDER BY (x + w / 2.0 - 85) * (x + w / 2.0 - 85) + (y + h / 2.0 - 90) * (y + h / 2.0 - 90), id LIMIT 25")
def T1_nearest_marks(spark, d):
    return M.viewport(_marks(spark, d), (20, 20, 150, 160), 1, 2, limit=25).select("id")


@query("SELECT layer, id, n AS rank FROM (SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY w * h DESC, id) AS n FROM v_marks) WHERE n <= 20")
def T3_top_of_groups(spark, d):
    return M.top_of_groups(view(spark, d, "v_marks"), ["layer"], [(F.col("w") * F.col("h")).desc(), F.col("id")], 20).select("layer", "id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT layer, visible_zoom_level AS zoom, CAST(count(*) AS BIGINT) AS n FROM v_marks GROUP BY 1, 2")
def D2_index_partitions(spark, d):
    return view(spark, d, "v_marks").groupBy("layer", F.col("visible_zoom_level").alias("zoom")).agg(F.count("*").alias("n"))


@query("SELECT id FROM v_marks WHERE id % 3 <> 0")
def D3_delete(spark, d):
    m = view(spark, d, "v_marks")
    return M.deleted(m, m.filter("id % 3 = 0")).select("id")


@query("""SELECT id, '{' || CASE WHEN h <> 1 THEN '"h":' || h || ',' ELSE '' END || '"id":' || id || CASE WHEN layer <> 0 THEN ',"layer":' || layer ELSE '' END || '}' AS json FROM v_marks""")
def K15_export(spark, d):
    return M.exported(view(spark, d, "v_marks").select("id", "layer", "h"), {"layer": 0, "h": 1})


@query("SELECT id, layer, CASE WHEN layer <= 1 THEN 1.0 ELSE 0.5 END AS opacity FROM v_marks WHERE layer <= 2 AND NOT (layer < 0)")
def X9_visible_layers(spark, d):
    floor = 1
    shown = view(spark, d, "v_marks").filter((F.col("layer") <= floor + 1) & ~((F.lit(floor) >= 0) & (F.col("layer") < 0)))
    return shown.select("id", "layer", F.when(F.col("layer") <= floor, 1.0).otherwise(0.5).alias("opacity"))


@query("SELECT id, row_number() OVER (PARTITION BY type ORDER BY layer, x, id) AS position FROM v_marks")
def X8_draw_order(spark, d):
    from pyspark.sql import Window

    return view(spark, d, "v_marks").select("id", F.row_number().over(Window.partitionBy("type").orderBy("layer", "x", "id")).cast("bigint").alias("position"))


@query("""SELECT a.layer, CAST(sum((least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * (least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y))) AS BIGINT) AS overlap FROM v_marks a JOIN v_marks b ON a.layer = b.layer AND a.id < b.id AND least(a.x+a.w, b.x+b.w) > greatest(a.x, b.x) AND least(a.y+a.h, b.y+b.h) > greatest(a.y, b.y) GROUP BY a.layer""")
def A22_total_overlap(spark, d):
    from ..operators.coverage import total_overlap

    return total_overlap(view(spark, d, "v_marks"), ["layer"])


@query("SELECT id, x + 3 AS moved_x, y - 2 AS moved_y, greatest(w - 5, 1) AS new_w, CAST(1 AS BIGINT) AS left_over, x + 10 AS kept_x FROM v_marks")
def D8_area_edits(spark, d):
    rects = F.array(F.struct("x", "y", "w", "h"), F.struct((F.col("x") + 10).alias("x"), "y", "w", "h"))
    m = view(spark, d, "v_marks").select("id", rects.alias("r"), "w", "h")
    out = m.select("id", M.moved("r", 0, 3, -2)[0].alias("m"), M.resized("r", 0, F.col("w") - 5, F.col("h"))[0].alias("s"), M.without_rect("r", 0).alias("rest"))
    return out.select("id", F.col("m.x").alias("moved_x"), F.col("m.y").alias("moved_y"), F.col("s.w").alias("new_w"), F.size("rest").cast("bigint").alias("left_over"), F.col("rest")[0]["x"].alias("kept_x"))


@query("SELECT id, (x + w - y - 6 * 0 >= -20) AS right_of, x - y AS diff, x + y - 6 * layer AS total FROM v_marks WHERE x - y BETWEEN -30 AND 80 AND x + y - 6 * layer BETWEEN 60 AND 220")
def X7_range_contains(spark, d):
    diff, total = C.to_grid("x", "y")
    m = view(spark, d, "v_marks").withColumn("diff", diff).withColumn("total", total - F.col("layer") * C.GRID_ROWS_PER_LAYER)
    return m.filter(F.col("diff").between(-30, 80) & F.col("total").between(60, 220)).select("id", (F.col("x") + F.col("w") - F.col("y") >= -20).alias("right_of"), "diff", "total")


_STR = """n AS (SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS leaves FROM v_marks), k AS (SELECT CASE WHEN leaves > 1 THEN CAST(floor(sqrt(leaves - 1)) AS BIGINT) + 1 ELSE 1 END AS strips FROM n),
  a AS (SELECT *, (row_number() OVER (ORDER BY 2 * x + w, id) - 1) // (strips * 16) AS strip FROM v_marks, k), b AS (SELECT *, (row_number() OVER (ORDER BY strip, 2 * y + h, id) - 1) AS rank FROM a),
  o AS (SELECT level, CAST(rank // CAST(pow(16, level + 1) AS BIGINT) AS BIGINT) AS node, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2 FROM b, range(0, 12) t(level) WHERE level = 0 OR pow(16, level - 1) < (SELECT leaves FROM n) * 1.0 GROUP BY ALL)"""


def _tree(spark, d):
    from ..operators.packed_tree import load

    return load(view(spark, d, "v_marks").select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")))


@query("""SELECT q.id AS q, m.id AS id FROM v_marks q JOIN v_marks m ON q.id % 23 = 0 AND m.x <= q.x + q.w + 5 AND q.x - 5 <= m.x + m.w AND m.y <= q.y + q.h + 5 AND q.y - 5 <= m.y + m.h""")
def D7_J8_packed_tree_search(spark, d):
    """Windows around marks whose id is divisible by 23, by way of the tree; the SQL scans all."""
    from ..operators.packed_tree import search

    w = view(spark, d, "v_marks").filter("id % 23 = 0").select(F.col("id").alias("q"), (F.col("x") - 5).alias("x1"), (F.col("y") - 5).alias("y1"), (F.col("x") + F.col("w") + 5).alias("x2"), (F.col("y") + F.col("h") + 5).alias("y2"))
    return search(_tree(spark, d), w)


@query(f"""WITH {_STR} SELECT CAST(level AS BIGINT) AS level, count(DISTINCT a) AS nodes, CAST(coalesce(sum(area), 0) AS BIGINT) AS overlap FROM (SELECT a.level, a.node AS a, CASE WHEN b.node IS NULL THEN 0 ELSE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) END AS area
  FROM o a LEFT JOIN o b ON a.level = b.level AND a.node // 16 = b.node // 16 AND a.node < b.node) GROUP BY level""")
def A22_sibling_overlap(spark, d):
    """How much of each other the nodes below one parent cover, for each level of the packed tree."""
    from ..operators.packed_tree import sibling_overlap

    s = sibling_overlap(_tree(spark, d))
    return s.select(*(F.col(c).cast("bigint").alias(c) for c in ("level", "nodes", "overlap")))
