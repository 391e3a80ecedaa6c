"""Queries over geometry, spatial joins and windows (G, J4-J9, J16, W, C1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import geometry as G
from ..operators import coverage
from ..operators import joins as J
from ..operators import quadtree as Q
from ..operators import scans
from ..operators import windows as W
from ..storage import tasks_for
from .catalogue import query
from .views import view

# a hexagon with a dent, and a square hole
RING = [(10, 5), (90, 15), (140, 80), (75, 60), (60, 120), (5, 70)]
HOLE = [(40, 30), (60, 30), (60, 50), (40, 50)]


def _edges(ring):
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]


def _ring(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))


_WIND = " + ".join(f"(CASE WHEN {y1} <= y AND {y2} > y AND ({x2} - {x1}) * (y - {y1}) - (x - {x1}) * ({y2} - {y1}) > 0 THEN 1 WHEN {y2} <= y AND {y1} > y AND ({x2} - {x1}) * (y - {y1}) - (x - {x1}) * ({y2} - {y1}) < 0 THEN -1 ELSE 0 END)" for x1, y1, x2, y2 in _edges(RING))
_HITS = " + ".join(f"(CASE WHEN x >= {min(x1, x2)} AND x < {max(x1, x2)} AND y < {y1} + ({y2} - {y1}) * (x - {x1}) / CAST({x2} - {x1} AS DOUBLE) THEN 1 ELSE 0 END)" for x1, y1, x2, y2 in _edges(RING) + _edges(HOLE) if x1 != x2)


@query(f"SELECT DISTINCT x, y FROM v_points WHERE ({_WIND}) <> 0")
def G1_point_in_polygon(spark, d):
    return view(spark, d, "v_points").select("x", "y").distinct().filter(G.in_polygon(_ring(RING), "x", "y"))


@query(f"SELECT DISTINCT x, y FROM v_points WHERE ({_HITS}) % 2 = 1")
def G2_even_odd(spark, d):
    return view(spark, d, "v_points").select("x", "y").distinct().filter(G.even_odd(F.array(_ring(RING), _ring(HOLE)), "x", "y"))


@query("SELECT r.id, CAST(count(*) AS BIGINT) AS n FROM v_rects r JOIN v_points p ON p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h GROUP BY r.id")
def G3_points_in_rects(spark, d):
    """Points are counted by square before they meet rectangles."""
    p = view(spark, d, "v_points").groupBy("x", "y").agg(F.count("*").alias("n"))
    return J.point_join(p, view(spark, d, "v_rects").select("id", "x", "y", "w", "h")).groupBy(F.col("r.id").alias("id")).agg(F.sum("p.n").alias("n"))


_CLIP = """WITH s AS (SELECT *, x1 - x0 AS dx, y1 - y0 AS dy FROM {src}),
t AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN ({a} - x0) / dx WHEN dx < 0 THEN ({c} - x0) / dx ELSE 0 END, CASE WHEN dy > 0 THEN ({b} - y0) / dy WHEN dy < 0 THEN ({e} - y0) / dy ELSE 0 END) AS t0,
  least(1.0, CASE WHEN dx > 0 THEN ({c} - x0) / dx WHEN dx < 0 THEN ({a} - x0) / dx ELSE 1 END, CASE WHEN dy > 0 THEN ({e} - y0) / dy WHEN dy < 0 THEN ({b} - y0) / dy ELSE 1 END) AS t1 FROM s
  WHERE NOT (dx = 0 AND (x0 < {a} OR x0 > {c})) AND NOT (dy = 0 AND (y0 < {b} OR y0 > {e})))
"""


@query(_CLIP.format(src="v_segments", a=-100, b=-80, c=120, e=60) + "SELECT id, round(x0 + t0 * dx, 6) + 0.0 AS xa, round(y0 + t0 * dy, 6) + 0.0 AS ya, round(x0 + t1 * dx, 6) + 0.0 AS xb, round(y0 + t1 * dy, 6) + 0.0 AS yb FROM t WHERE t0 <= t1")
def G5_clip_segment(spark, d):
    c = view(spark, d, "v_segments").select("id", G.clip_segment("x0", "y0", "x1", "y1", -100, -80, 120, 60).alias("c")).filter("c is not null")
    return c.select("id", *((F.round(f"c.{k}", 6) + 0.0).alias(k) for k in ("xa", "ya", "xb", "yb")))


@query(_CLIP.format(src="(SELECT id, x0 - y0 AS x0, x0 + y0 AS y0, x1 - y1 AS x1, x1 + y1 AS y1 FROM v_segments)", a=-90, b=-70, c=110, e=130) + """, c AS (SELECT id, x0 + t0 * dx AS da, y0 + t0 * dy AS sa, x0 + t1 * dx AS db, y0 + t1 * dy AS sb FROM t WHERE t0 <= t1)
  SELECT id, round((sa + da) / 2, 6) + 0.0 AS xa, round((sa - da) / 2, 6) + 0.0 AS ya, round((sb + db) / 2, 6) + 0.0 AS xb, round((sb - db) / 2, 6) + 0.0 AS yb FROM c""")
def G6_clip_iso(spark, d):
    c = view(spark, d, "v_segments").select("id", G.clip_segment_iso("x0", "y0", "x1", "y1", -90, -70, 110, 130).alias("c")).filter("c is not null")
    return c.select("id", *((F.round(f"c.{k}", 6) + 0.0).alias(k) for k in ("xa", "ya", "xb", "yb")))


@query("""WITH t AS (SELECT *, CASE WHEN (x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) = 0 THEN 0 ELSE greatest(0.0, least(1.0, ((7-x0)*(x1-x0)+(11-y0)*(y1-y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) END AS t FROM v_segments)
  SELECT id, round(x0 + t*(x1-x0), 6) + 0.0 AS x, round(y0 + t*(y1-y0), 6) + 0.0 AS y, round((7-x0-t*(x1-x0))*(7-x0-t*(x1-x0)) + (11-y0-t*(y1-y0))*(11-y0-t*(y1-y0)), 4) + 0.0 AS d2 FROM t""")
def G7_closest_point(spark, d):
    c = view(spark, d, "v_segments").select("id", G.closest_on_segment(F.lit(7), F.lit(11), "x0", "y0", "x1", "y1").alias("c"))
    return c.select("id", (F.round("c.x", 6) + 0.0).alias("x"), (F.round("c.y", 6) + 0.0).alias("y"), (F.round("c.d2", 4) + 0.0).alias("d2"))


@query("""SELECT a.id AS id, greatest(least(a.x+a.w, 100) - greatest(a.x, 60), 0) * greatest(least(a.y+a.h, 120) - greatest(a.y, 50), 0) AS shared, least(a.x, 60) AS ux, least(a.y, 50) AS uy, greatest(a.x+a.w, 100) - least(a.x, 60) AS uw, greatest(a.y+a.h, 120) - least(a.y, 50) AS uh, (a.x >= 60 AND a.y >= 50 AND a.x+a.w <= 100 AND a.y+a.h <= 120) AS held FROM v_rects a""")
def G8_box_algebra(spark, d):
    a = {k: F.col(k) for k in "xywh"}
    b = {k: F.lit(v) for k, v in zip("xywh", (60, 50, 40, 70), strict=True)}
    u = G.union_box(a, b)
    return view(spark, d, "v_rects").select("id", G.overlap_area(a, b).alias("shared"), u["x"].alias("ux"), u["y"].alias("uy"), u["w"].alias("uw"), u["h"].alias("uh"), G.contains_box(b, a).alias("held"))


_SX, _SY = "(least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x))", "(least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y))"
_MODES = {"closed": f"{_SX} >= 0 AND {_SY} >= 0", "no_corner": f"{_SX} >= 0 AND {_SY} >= 0 AND ({_SX} > 0 OR {_SY} > 0)", "no_edge": f"(({_SX} > 0 AND {_SY} > 0) OR ({_SX} = 0 AND {_SY} = 0))", "open": f"{_SX} > 0 AND {_SY} > 0"}


def _neighbour_query(mode: str):
    @query(f"SELECT a.id AS id, b.id AS other FROM v_rects a JOIN v_rects b ON a.id <> b.id AND {_MODES[mode]}")
    def run(spark, d):
        return J.neighbours(view(spark, d, "v_rects"), mode)

    return run


def _named(name: str, make):
    """Registers a query of a family under a name of its own."""
    from .catalogue import QUERIES, SQL

    make()
    QUERIES[name] = QUERIES.pop("run")
    SQL[name] = SQL.pop("run")


for _mode in G.RELATIONS:
    _named(f"J6_rect_neighbours_{_mode}", lambda m=_mode: _neighbour_query(m))


@query("""WITH o AS (SELECT grp, id, s, e, CASE WHEN s > max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens FROM v_intervals),
  i AS (SELECT grp, s, e, sum(opens) OVER (PARTITION BY grp ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o) SELECT grp, min(s) AS s, max(e) AS e FROM i GROUP BY grp, island""")
def G10_merge_intervals(spark, d):
    return W.merge_intervals(view(spark, d, "v_intervals"), ["grp"])


@query("""SELECT id, greatest((s - 100) / 800.0, 0.0) AS a, least((e - 100) / 800.0, 1.0) AS b FROM v_intervals WHERE greatest((s - 100) / 800.0, 0.0) < least((e - 100) / 800.0, 1.0)""")
def G11_edge_ratio(spark, d):
    r = view(spark, d, "v_intervals").select("id", G.ratio_on_edge("s", "e", F.lit(100), F.lit(900)).alias("r")).filter("r is not null")
    return r.select("id", "r.a", "r.b")


@query("""WITH pts AS (SELECT DISTINCT grp, unnest(range(greatest(s, 0), least(e, 1000))) AS p FROM v_intervals WHERE s < e),
  every AS (SELECT DISTINCT grp, p FROM (SELECT DISTINCT grp FROM v_intervals), range(0, 1000) t(p)),
  free AS (SELECT grp, p, p - row_number() OVER (PARTITION BY grp ORDER BY p) AS island FROM (SELECT grp, p FROM every EXCEPT SELECT grp, p FROM pts))
  SELECT grp, min(p) AS s, max(p) + 1 AS e FROM free GROUP BY grp, island""")
def G13_exposed_gaps(spark, d):
    i = view(spark, d, "v_intervals").filter("s < e").withColumn("lo", F.lit(0).cast("bigint")).withColumn("hi", F.lit(1000).cast("bigint"))
    return W.gaps(i, ["grp"], "lo", "hi").select("grp", "s", "e")


@query("""WITH sq AS (SELECT DISTINCT layer, unnest(range(x, x + w)) AS x, y, h FROM v_rects), s AS (SELECT DISTINCT layer, x, unnest(range(y, y + h)) AS y FROM sq),
  i AS (SELECT layer, x, y, y - row_number() OVER (PARTITION BY layer, x ORDER BY y) AS k FROM s), r AS (SELECT layer, x, min(y) AS y, count(*) AS n FROM i GROUP BY layer, x, k),
  c AS (SELECT layer, x, list(y || ':' || n ORDER BY y) AS slots FROM r GROUP BY layer, x), j AS (SELECT layer, x, slots, x - row_number() OVER (PARTITION BY layer, slots ORDER BY x) AS k FROM c),
  st AS (SELECT layer, slots, min(x) AS x, count(*) AS w FROM j GROUP BY layer, slots, k), u AS (SELECT layer, x, w, unnest(slots) AS slot FROM st)
  SELECT layer, x, CAST(split_part(slot, ':', 1) AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(split_part(slot, ':', 2) AS BIGINT) AS h FROM u""")
def G17_rect_cover(spark, d):
    r = view(spark, d, "v_rects")
    squares = r.select("layer", F.explode(G.squares_of("x", "y", "w", "h")).alias("p")).select("layer", "p.x", "p.y").distinct()
    return W.rect_cover(squares, ["layer"])


@query("SELECT type, CAST(count(*) AS BIGINT) AS squares, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM (SELECT DISTINCT type, px AS x, unnest(range(y, y + h)) AS y FROM (SELECT type, unnest(range(x, x + w)) AS px, y, h FROM v_rects)) GROUP BY type")
def G19_rect_squares(spark, d):
    s = view(spark, d, "v_rects").select("type", F.explode(G.squares_of("x", "y", "w", "h")).alias("p")).select("type", "p.x", "p.y").distinct()
    return s.groupBy("type").agg(F.count("*").alias("squares"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


_SQUARES = "s AS (SELECT DISTINCT layer, x, unnest(range(y, y + h)) AS y FROM (SELECT layer, unnest(range(x, x + w)) AS x, y, h FROM v_rects))"


def _squares(spark, d):
    return view(spark, d, "v_rects").select("layer", F.explode(G.squares_of("x", "y", "w", "h")).alias("p")).select("layer", "p.x", "p.y").distinct()


@query(f"""WITH {_SQUARES}, f AS (SELECT layer, x, y, EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x AND b.y = a.y - 1) AS n, EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x + 1 AND b.y = a.y) AS e,
  EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x AND b.y = a.y + 1) AS s, EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x - 1 AND b.y = a.y) AS w FROM s a) SELECT layer, x, y, n, e, s, w FROM f WHERE NOT (n AND e AND s AND w)""")
def G21_border_flags(spark, d):
    from ..operators.borders import border_flags

    return border_flags(_squares(spark, d), ["layer"])


@query(f"""WITH {_SQUARES}, f AS (SELECT layer, x, y, EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x AND b.y = a.y - 1) AS n, EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x + 1 AND b.y = a.y) AS e,
  EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x AND b.y = a.y + 1) AS s, EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.x = a.x - 1 AND b.y = a.y) AS w FROM s a)
  SELECT layer, x, y, 'n' AS side, 64 * x + CASE WHEN w THEN -2 ELSE 2 END AS x1, 32 * y + 1 AS y1, 64 * (x + 1) + CASE WHEN e THEN 2 ELSE -2 END AS x2, 32 * y + 1 AS y2 FROM f WHERE NOT n
  UNION ALL SELECT layer, x, y, 'e', 64 * (x + 1) - 2, 32 * y + CASE WHEN n THEN -1 ELSE 1 END, 64 * (x + 1) - 2, 32 * (y + 1) + CASE WHEN s THEN 1 ELSE -1 END FROM f WHERE NOT e
  UNION ALL SELECT layer, x, y, 's', 64 * (x + 1) + CASE WHEN e THEN 2 ELSE -2 END, 32 * (y + 1) - 1, 64 * x + CASE WHEN w THEN -2 ELSE 2 END, 32 * (y + 1) - 1 FROM f WHERE NOT s
  UNION ALL SELECT layer, x, y, 'w', 64 * x + 2, 32 * (y + 1) + CASE WHEN s THEN 1 ELSE -1 END, 64 * x + 2, 32 * y + CASE WHEN n THEN -1 ELSE 1 END FROM f WHERE NOT w""")
def G22_edge_segments(spark, d):
    from ..operators.borders import border_flags, edge_segments

    return edge_segments(border_flags(_squares(spark, d), ["layer"]), ["layer"], 64, 32, 2, 1)


@query("WITH r AS (SELECT type, x, y, row_number() OVER (PARTITION BY type ORDER BY x + y, x) AS n FROM v_rects) SELECT type, x, y FROM r WHERE n = 1")
def G23_label_anchor(spark, d):
    return view(spark, d, "v_rects").groupBy("type").agg(G.label_anchor().alias("p")).select("type", "p.x", "p.y")


_D = lambda a, n: f"CAST(floor(({a}) / {n}.0) AS BIGINT)"


@query(f"""WITH b AS (SELECT id, {_D('x - (y + h - 1) - 1', 16)} AS a, {_D('x + w - 1 - y + 1', 16)} AS c, {_D('x + y - 7', 32)} AS e, {_D('x + w - 1 + y + h - 1 + 1', 32)} AS g FROM v_rects),
  t AS (SELECT id, unnest(range(a, c + 1)) AS tx, e, g FROM b) SELECT id, tx, unnest(range(e, g + 1)) AS ty FROM t""")
def G24_tiles_rough(spark, d):
    return view(spark, d, "v_rects").select("id", F.explode(G.rect_tiles_rough("x", "y", "w", "h")).alias("t")).select("id", "t.tx", "t.ty")


_OCT = ["(x - y - 1, x + y - 7)", "(x - y + 1, x + y - 7)", "(x + w - 1 - y + 1, x + w - 1 + y - 7)", "(x + w - 1 - y + 1, x + w - 1 + y + 1)", "(x + w - 1 - (y + h - 1) + 1, x + w - 1 + y + h - 1 + 1)", "(x + w - 1 - (y + h - 1) - 1, x + w - 1 + y + h - 1 + 1)", "(x - (y + h - 1) - 1, x + y + h - 1 + 1)", "(x - (y + h - 1) - 1, x + y + h - 1 - 7)"]
_VERTS = " UNION ALL ".join(f"SELECT id, {i} AS k, {p[1:-1].rsplit(', ', 1)[0]} AS vx, {p[1:-1].rsplit(', ', 1)[1]} AS vy FROM v_rects" for i, p in enumerate(_OCT))


_G25 = f"""WITH v AS ({_VERTS}), e AS (SELECT a.id, CASE WHEN a.vy > b.vy THEN b.vx ELSE a.vx END AS x0, least(a.vy, b.vy) AS y0, CASE WHEN a.vy > b.vy THEN a.vx ELSE b.vx END AS x1, greatest(a.vy, b.vy) AS y1 FROM v a JOIN v b ON a.id = b.id AND b.k = (a.k + 1) % 8),
  r AS (SELECT id, min({_D('y0', 32)}) AS t0, max({_D('y1 - 1', 32)}) AS t1 FROM e GROUP BY id), y AS (SELECT id, unnest(range(t0, t1 + 1)) AS ty FROM r),
  c AS (SELECT e.id, ty, x0, x1, y0, y1, (greatest(y0, ty * 32) - y0) * (x1 - x0) AS n0, (least(y1, ty * 32 + 32) - y0) * (x1 - x0) AS n1 FROM e JOIN y ON e.id = y.id AND y1 >= ty * 32 AND y0 <= ty * 32 + 32),
  s AS (SELECT id, ty, min(CASE WHEN y0 = y1 THEN least(x0, x1) ELSE x0 + CAST(floor(least(n0, n1) / CAST(y1 - y0 AS DOUBLE)) AS BIGINT) END) AS lo, max(CASE WHEN y0 = y1 THEN greatest(x0, x1) ELSE x0 + CAST(ceil(greatest(n0, n1) / CAST(y1 - y0 AS DOUBLE)) AS BIGINT) END) AS hi FROM c GROUP BY id, ty)
  SELECT id, unnest(range({_D('lo', 16)}, {_D('hi - 1', 16)} + 1)) AS tx, ty FROM s"""
_G25_PARTS, _G25_ROWS = _G25.rsplit("\n", 1)
_G25_TABLE = f"{_G25_PARTS}, g AS (SELECT DISTINCT * FROM ({_G25_ROWS}))"


@query(_G25)
def G25_tiles_octagon(spark, d):
    return G.rect_tiles(view(spark, d, "v_rects").select("id", "x", "y", "w", "h")).select("id", "tx", "ty")


@query(f"WITH t AS (SELECT id, unnest(range({_D('x', 8)}, {_D('x + w - 1', 8)} + 1)) AS tx, {_D('y', 8)} AS a, {_D('y + h - 1', 8)} AS b FROM v_rects) SELECT id, tx, unnest(range(a, b + 1)) AS ty FROM t")
def G26_tiles_top(spark, d):
    return view(spark, d, "v_rects").select("id", F.explode(G.rect_tiles_top("x", "y", "w", "h", 8)).alias("t")).select("id", "t.tx", "t.ty")


@query("""WITH p AS (SELECT id, unnest(range(x, x + w * h)) AS p FROM v_rects), q AS (SELECT id, p // 16 AS y, min(p % 16) AS x, count(*) AS w FROM p GROUP BY id, p // 16)
  SELECT id, CAST(sum(w) AS BIGINT) AS squares, CAST(count(*) AS BIGINT) AS row_parts, min(y) AS first_row, max(y) AS last_row FROM q GROUP BY id""")
def G27_run_segments(spark, d):
    r = view(spark, d, "v_rects").select("id", F.explode(G.run_segments("x", F.col("w") * F.col("h"), 16)).alias("s"))
    return r.groupBy("id").agg(F.sum(F.col("s.w") * F.col("s.h")).alias("squares"), F.sum("s.h").alias("row_parts"), F.min("s.y").alias("first_row"), F.max(F.col("s.y") + F.col("s.h") - 1).alias("last_row"))


# a shift keeps exact halves away from where numbers are cut
@query(_CLIP.format(src="v_segments", a=-100, b=-80, c=120, e=60) + """SELECT id, CAST(floor((x0 + (t0 + t1) / 2 * dx) * 1000 + 0.3) AS BIGINT) AS x_milli, CAST(floor((y0 + (t0 + t1) / 2 * dy) * 1000 + 0.3) AS BIGINT) AS y_milli FROM t WHERE t0 <= t1""")
def G28_label_position(spark, d):
    points = F.array(*(F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (0, 1, 1)))
    p = view(spark, d, "v_segments").select("id", G.longest_visible(points, (-100, -80, 120, 60)).alias("p")).filter("p is not null")
    return p.select("id", *(F.floor(F.col(f"p.{k}") * 1000 + 0.3).cast("bigint").alias(f"{k}_milli") for k in "xy"))


@query(f"WITH c AS (SELECT id, unnest(range({_D('x', 32)}, {_D('x + w - 1', 32)} + 1)) AS cx, {_D('y', 32)} AS a, {_D('y + h - 1', 32)} AS b FROM v_rects) SELECT id, cx, unnest(range(a, b + 1)) AS cy FROM c")
def J4_object_cells(spark, d):
    return J.cells_of(view(spark, d, "v_rects"), 32).select("id", "cx", "cy")


@query("""WITH p AS (SELECT DISTINCT x, y FROM v_points), m AS (SELECT p.x, p.y, min(r.id) AS id FROM p JOIN v_rects r ON p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h GROUP BY p.x, p.y) SELECT m.x, m.y, m.id, r.type FROM m JOIN v_rects r USING (id)""")
def J5_first_zone(spark, d):
    p = view(spark, d, "v_points").select("x", "y").distinct()
    return J.first_zone(p, view(spark, d, "v_rects"), "id").select("p.x", "p.y", "r.id", "r.type")


@query("SELECT a.id AS id, CAST(count(*) AS BIGINT) AS n FROM v_intervals a JOIN v_intervals b ON a.grp = b.grp AND a.s <= b.e AND a.e >= b.s GROUP BY a.id")
def J7_interval_join(spark, d):
    i = view(spark, d, "v_intervals")
    return J.interval_join(i, i, 16, ("grp",)).groupBy(F.col("a.id").alias("id")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT a.id FROM v_rects a JOIN v_rects b ON b.id > a.id AND a.layer = b.layer AND {_MODES['open']}")
def J16_overlaid_by_later(spark, d):
    """Rectangles that a later one of their layer overlaps; no pairs are listed."""
    r = view(spark, d, "v_rects").select("id", "layer", "x", "y", "w", "h")
    return Q.related_keys(r, r, "id", "open", ("layer",), "b_id > a_id")


@query(f"SELECT a.id AS id, CAST(count(*) AS BIGINT) AS n, CAST(sum(b.id) AS BIGINT) AS others FROM v_world a JOIN v_world b ON a.id <> b.id AND {_MODES['closed']} GROUP BY a.id")
def J6_world_neighbours(spark, d):
    """Neighbours in a world that grows with the table, with a third of it in hot spots, and rectangles over whole regions."""
    r = view(spark, d, "v_world").select("id", "x", "y", "w", "h")
    pairs = Q.rect_pairs(r, r).filter("a.id <> b.id")
    return pairs.groupBy(F.col("a.id").alias("id")).agg(F.count("*").alias("n"), F.sum("b.id").alias("others"))


@query("""WITH p AS (SELECT x * 7 AS x, y % 193 AS y, CAST(count(*) AS BIGINT) AS n FROM v_points GROUP BY x * 7, y % 193) SELECT r.id, CAST(sum(p.n) AS BIGINT) AS points FROM p JOIN v_world r ON p.x >= r.x AND p.x < r.x + r.w AND p.y >= r.y AND p.y < r.y + r.h GROUP BY r.id""")
def J4_J9_world_points(spark, d):
    """Points in each rectangle of the world, counted by square before they meet rectangles."""
    p = view(spark, d, "v_points").groupBy((F.col("x") * 7).alias("x"), (F.col("y") % 193).alias("y")).agg(F.count("*").alias("n"))
    pairs = Q.point_pairs(p, view(spark, d, "v_world").select("id", "x", "y", "w", "h"))
    return pairs.groupBy(F.col("b.id").alias("id")).agg(F.sum("a.n").alias("points"))


@query(f"SELECT DISTINCT a.id FROM v_world a JOIN v_world b ON b.id > a.id AND a.layer = b.layer AND {_MODES['open']}")
def J16_world_overlaid(spark, d):
    r = view(spark, d, "v_world")
    return Q.related_keys(r, r, "id", "open", ("layer",), "b_id > a_id")


def _on_tiles(spark, d):
    """Units with each isometric tile that their square rectangle reaches."""
    return G.rect_tiles(view(spark, d, "v_rects").select("id", "layer", "x", "y", "w", "h")).select("id", "layer", "tx", "ty").distinct()


@query(f"{_G25_TABLE} SELECT tx, ty, CAST(count(*) AS BIGINT) AS units, min(id) AS least, max(id) AS most, CAST(sum(layer) AS BIGINT) AS layers FROM g JOIN v_rects USING (id) GROUP BY tx, ty")
def J9_units_on_tiles(spark, d):
    """Source units by the tiles that they reach."""
    return _on_tiles(spark, d).groupBy("tx", "ty").agg(F.count("*").alias("units"), F.min("id").alias("least"), F.max("id").alias("most"), F.sum("layer").alias("layers"))


@query(f"{_G25_TABLE} SELECT tx, ty, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS sources FROM g GROUP BY tx, ty")
def X24_tile_sources(spark, d):
    """The units that contribute to each tile, in order."""
    t = _on_tiles(spark, d).groupBy("tx", "ty").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return t.select("tx", "ty", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("sources"))


@query(f"{_G25_TABLE} SELECT CAST(max(n) AS BIGINT) AS fan_in, CAST(count(*) AS BIGINT) AS tiles, CAST(sum(n) AS BIGINT) AS links FROM (SELECT count(*) AS n FROM g GROUP BY tx, ty)")
def X25_tile_fan_in(spark, d):
    """The index from tiles to units: how many units its fullest tile has."""
    t = _on_tiles(spark, d).groupBy("tx", "ty").agg(F.count("*").alias("n"))
    return t.agg(F.max("n").alias("fan_in"), F.count("*").alias("tiles"), F.sum("n").alias("links"))


@query(f"""{_G25_TABLE}, b AS (SELECT id, {_D('x - (y + h - 1) - 1', 16)} AS a, {_D('x + w - 1 - y + 1', 16)} AS c, {_D('x + y - 7', 32)} AS e, {_D('x + w - 1 + y + h - 1 + 1', 32)} AS f FROM v_rects),
  t AS (SELECT id, unnest(range(a, c + 1)) AS tx, e, f FROM b), rough AS (SELECT id, tx, unnest(range(e, f + 1)) AS ty FROM t)
  SELECT CAST(count(*) FILTER (WHERE r.id IS NOT NULL AND g.id IS NOT NULL) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE g.id IS NULL) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE r.id IS NULL) AS BIGINT) AS fn FROM rough r FULL JOIN g ON r.id = g.id AND r.tx = g.tx AND r.ty = g.ty""")
def A23_precision_recall(spark, d):
    """The rough cover of units by tiles held against the exact one: what it finds rightly, too much, and not."""
    truth = _on_tiles(spark, d).select("id", "tx", "ty", F.lit(True).alias("truth"))
    rough = view(spark, d, "v_rects").select("id", F.explode(G.rect_tiles_rough("x", "y", "w", "h")).alias("t")).select("id", "t.tx", "t.ty", F.lit(True).alias("found"))
    both = rough.join(truth, ["id", "tx", "ty"], "full_outer")
    return both.agg(F.count_if(F.col("found") & F.col("truth")).alias("tp"), F.count_if(F.col("found") & F.col("truth").isNull()).alias("fp"), F.count_if(F.col("found").isNull()).alias("fn"))


@query("""WITH s AS (SELECT DISTINCT layer, x, y FROM v_points), i AS (SELECT layer, x, y, y - row_number() OVER (PARTITION BY layer, x ORDER BY y) AS k FROM s) SELECT layer, x, min(y) AS start, CAST(count(*) AS BIGINT) AS length FROM i GROUP BY layer, x, k""")
def W1_runs(spark, d):
    return W.runs(view(spark, d, "v_points"), ["layer", "x"], "y")


@query("""WITH v AS (SELECT s.id AS p, CASE WHEN id % 4 = 1 THEN NULL ELSE (id // 7) % 3 END AS v FROM v_rects s), k AS (SELECT p, v, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (ORDER BY p) AND lag(p) OVER (ORDER BY p) IS NOT NULL THEN 0 ELSE 1 END AS c FROM v WHERE v IS NOT NULL),
  i AS (SELECT p, v, sum(c) OVER (ORDER BY p) AS i FROM k) SELECT v, min(p) AS start, max(p) - min(p) + 1 AS length FROM i GROUP BY i, v""")
def W2_fill_runs(spark, d):
    v = view(spark, d, "v_rects").select(F.lit(0).alias("g"), F.col("id").alias("at"), F.when(F.col("id") % 4 != 1, F.expr("(id div 7) % 3")).alias("v"))
    return scans.fill_runs(v, ["g"], "at", "v").drop("g")


@query("""SELECT type, min(id) AS first_id, max(id) AS last_id FROM v_rects GROUP BY type""")
def W3_first_last(spark, d):
    r = view(spark, d, "v_rects").select("type", "id")
    first = W.first_of(r, ["type"], ["id"]).withColumnRenamed("id", "first_id")
    return first.join(W.first_of(r, ["type"], ["id"], last=True).withColumnRenamed("id", "last_id"), "type")


@query("""WITH e AS (SELECT grp, s AS p, 1 AS o FROM v_intervals UNION ALL SELECT grp, e, -1 FROM v_intervals), a AS (SELECT grp, o, coalesce(sum(o) OVER (PARTITION BY grp ORDER BY p, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM e) SELECT grp, CAST(sum(n) AS BIGINT) AS cost FROM a WHERE o = 1 GROUP BY grp""")
def W5_sweep_cost(spark, d):
    return scans.sweep_cost(view(spark, d, "v_intervals"), ["grp"])


@query("""WITH v AS (SELECT id * 13 AS s, id * 13 + o AS e FROM (SELECT o_orderkey AS id, o_custkey % 60 AS o FROM orders)), m AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM v),
  i AS (SELECT s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT min(s) AS s, max(e) AS e FROM i GROUP BY i""")
def W4_merged_in_one_order(spark, d):
    """All orders as intervals of one line, merged without a task that holds the line."""
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") * 13).alias("s"), (F.col("o_orderkey") * 13 + F.col("o_custkey") % 60).alias("e"))
    return scans.merge_intervals(o.withColumn("g", F.lit(0)), ["g"]).drop("g")


@query("SELECT type, id, CAST(ntile(7) OVER (PARTITION BY type ORDER BY id) AS BIGINT) AS slice FROM v_rects")
def W6_slices(spark, d):
    return W.slices(view(spark, d, "v_rects").select("type", "id"), 7, ["id"], ["type"]).withColumn("slice", F.col("slice").cast("bigint"))


@query(f"""WITH RECURSIVE e AS (SELECT a.id AS a, b.id AS b FROM v_rects a JOIN v_rects b ON a.layer = b.layer AND a.id <> b.id AND {_MODES['open']}),
  r(id, component) USING KEY (id) AS (SELECT id, id FROM v_rects UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.id JOIN recurring.r AS old ON old.id = e.b WHERE r.component < old.component GROUP BY e.b) SELECT id, component FROM r""")
def C1_components(spark, d):
    """Rectangles that overlap in a layer, directly or through others."""
    return coverage.overlap_components(view(spark, d, "v_rects"), ["layer"])


_BY_TYPE = "s AS (SELECT DISTINCT type, x, unnest(range(y, y + h)) AS y FROM (SELECT type, unnest(range(x, x + w)) AS x, y, h FROM v_rects))"
#: Border edges of each type's squares and their followers, as numbers ((y * 10000 + x) * 4 + side); then walks from each
#: edge over greater ones, which go full circle from the least edge of a ring alone.
_RINGS = f"""{_BY_TYPE}, d(side, dx, dy, ox, oy) AS (VALUES (0, 1, 0, 0, -1), (1, 0, 1, 1, 0), (2, -1, 0, 0, 1), (3, 0, -1, -1, 0)),
  e AS (SELECT s.type, s.x, s.y, side, CAST((s.y * 10000 + s.x) * 4 + side AS BIGINT) AS id, CAST(CASE WHEN a.x IS NULL THEN (s.y * 10000 + s.x) * 4 + (side + 1) % 4 WHEN g.x IS NULL THEN ((s.y + dy) * 10000 + s.x + dx) * 4 + side ELSE ((s.y + dy + oy) * 10000 + s.x + dx + ox) * 4 + (side + 3) % 4 END AS BIGINT) AS nxt
    FROM s JOIN d ON true LEFT JOIN s o ON o.type = s.type AND o.x = s.x + ox AND o.y = s.y + oy LEFT JOIN s a ON a.type = s.type AND a.x = s.x + dx AND a.y = s.y + dy LEFT JOIN s g ON g.type = s.type AND g.x = s.x + dx + ox AND g.y = s.y + dy + oy WHERE o.x IS NULL),
  walk(type, start, id, nxt, pos) AS (SELECT type, id, id, nxt, 0 FROM e UNION ALL SELECT w.type, w.start, e.id, e.nxt, w.pos + 1 FROM walk w JOIN e ON e.type = w.type AND e.id = w.nxt WHERE w.nxt > w.start),
  full_ AS (SELECT DISTINCT type, start FROM walk WHERE nxt = start),
  r AS (SELECT w.type, w.start AS ring, w.pos, e.side, e.x, e.y, w.nxt % 4 AS turn FROM walk w JOIN full_ USING (type, start) JOIN e ON e.type = w.type AND e.id = w.id)"""
_CORNER = "x + CASE WHEN side IN (0, 1) THEN 1 ELSE 0 END AS x, y + CASE WHEN side IN (1, 2) THEN 1 ELSE 0 END AS y"
_number = lambda c: ((F.col(f"{c}.y") * 10000 + F.col(f"{c}.x")) * 4 + F.col(f"{c}.side")).cast("bigint").alias(c)


def _squares_by_type(spark, d):
    return view(spark, d, "v_rects").select("type", F.explode(G.squares_of("x", "y", "w", "h")).alias("p")).select("type", "p.x", "p.y").distinct()


@query(f"WITH RECURSIVE {_RINGS}, k AS (SELECT type, ring, CASE WHEN sum((x + CASE WHEN side IN (1, 2) THEN 1 ELSE 0 END) * CASE side WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END - (y + CASE WHEN side IN (2, 3) THEN 1 ELSE 0 END) * CASE side WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) > 0 THEN 'outer' ELSE 'hole' END AS kind FROM r GROUP BY type, ring) SELECT type, ring, kind, CAST(pos AS BIGINT) AS pos, {_CORNER} FROM r JOIN k USING (type, ring) WHERE side <> turn")
def G14_G15_ring_corners(spark, d):
    """The corners of all rings around each type's squares, in order; many components and holes to a type."""
    from ..operators.borders import ring_corners

    return ring_corners(_squares_by_type(spark, d), ["type"]).select("type", _number("ring"), "kind", "pos", "x", "y")


@query(f"WITH {_BY_TYPE} SELECT type, CAST(count(*) AS BIGINT) AS area FROM s GROUP BY type")
def G16_polygon_areas(spark, d):
    """Rings around each type's squares; outer rings and holes turn opposite ways, so that their signed areas add up to the squares."""
    from ..operators.borders import polygons

    rings = polygons(_squares_by_type(spark, d), ["type"])
    cross = F.aggregate(F.zip_with("points", G.rotated("points"), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return rings.withColumn("c", cross).groupBy("type").agg(F.call_function("div", F.sum("c"), F.lit(2)).alias("area"))


@query(f"""WITH RECURSIVE {_RINGS}, k AS (SELECT type, ring, sum((x + CASE WHEN side IN (1, 2) THEN 1 ELSE 0 END) * CASE side WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END - (y + CASE WHEN side IN (2, 3) THEN 1 ELSE 0 END) * CASE side WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END) > 0 AS around, CAST(sum(CASE WHEN side <> turn THEN 1 ELSE 0 END) AS BIGINT) AS corners FROM r GROUP BY type, ring)
  SELECT type, count(*) FILTER (around) AS paths, count(*) FILTER (NOT around) AS holes, CAST(sum(corners) AS BIGINT) AS corners FROM k GROUP BY type""")
def G16_X35_outlines(spark, d):
    """SVG paths of each type's components: how many, how many holes they have, and corners in them."""
    from ..operators.borders import outlines, polygons

    paths = outlines(polygons(_squares_by_type(spark, d), ["type"]), ["type"])
    lines, rest = F.regexp_count("path", F.lit("M")), F.regexp_count("path", F.lit("L"))
    return paths.groupBy("type").agg(F.count("*").alias("paths"), F.sum(lines - 1).cast("bigint").alias("holes"), F.sum(lines + rest).cast("bigint").alias("corners"))


@query(f"WITH {_BY_TYPE} SELECT type, CAST(count(*) AS BIGINT) AS area, CAST(count(*) AS BIGINT) AS squares, CAST(sum(x * 1000 + y) AS BIGINT) AS places FROM s GROUP BY type")
def G18_disjoint_cover(spark, d):
    """The cover's area and the squares it holds: equal, as no square is covered twice."""
    from ..operators.borders import disjoint_cover

    cover = disjoint_cover(view(spark, d, "v_rects").select("type", "x", "y", "w", "h"), ["type"])
    area = cover.groupBy("type").agg(F.sum(F.col("w") * F.col("h")).alias("area"))
    squares = cover.select("type", F.explode(G.squares_of("x", "y", "w", "h")).alias("p")).select("type", "p.x", "p.y").distinct()
    return area.join(squares.groupBy("type").agg(F.count("*").alias("squares"), F.sum(F.col("x") * 1000 + F.col("y")).alias("places")), "type")


@query("""WITH e AS (SELECT a.id AS id, greatest(a.y, b.y) AS s, least(a.y + a.h, b.y + b.h) AS e FROM v_rects a JOIN v_rects b ON a.id <> b.id AND a.layer = b.layer AND b.x + b.w >= a.x + a.w AND b.x <= a.x + a.w AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h)),
  p AS (SELECT DISTINCT id, unnest(range(s, e)) AS y FROM e) SELECT id, CAST(count(*) AS BIGINT) AS hidden FROM p GROUP BY id""")
def G12_covered_edge(spark, d):
    """How much of each rectangle's right edge neighbours cover."""
    return coverage.hidden_edges(view(spark, d, "v_rects"), ["layer"])


@query("SELECT id, i AS corner, CASE WHEN i IN (1, 2) THEN x + w ELSE x END - CASE WHEN i >= 2 THEN y + h ELSE y END AS gx, CASE WHEN i IN (1, 2) THEN x + w ELSE x END + CASE WHEN i >= 2 THEN y + h ELSE y END AS gy FROM v_rects, range(0, 4) t(i)")
def G29_clip_ring(spark, d):
    """Corners of rectangles on the isometric grid."""
    r = view(spark, d, "v_rects").select("id", F.posexplode(G.corners("x", "y", "w", "h")).alias("corner", "p"))
    gx, gy = C.to_grid("p.x", "p.y")
    return r.select("id", F.col("corner").cast("bigint").alias("corner"), gx.alias("gx"), gy.alias("gy"))


@query("""WITH o AS (SELECT id, x, y, w, h FROM v_rects WHERE id % 4 <> 0 UNION ALL SELECT id, x, y, CAST(1 AS BIGINT), h FROM v_rects WHERE id % 4 = 0 UNION ALL SELECT id, x + 2, y, CAST(1 AS BIGINT), h FROM v_rects WHERE id % 4 = 0 AND w > 2) SELECT id, x, y, w, h FROM o""")
def G20_object_rects(spark, d):
    """Rectangles as they are; other shapes (here: two columns of squares) as covers of their squares."""
    r = view(spark, d, "v_rects").select("id", "x", "y", "w", "h")
    plain = r.filter("id % 4 <> 0")
    shapes = r.filter("id % 4 = 0").select("id", "x", "w", F.explode(G.squares_of("x", "y", "w", "h")).alias("p")).filter("p.x - x in (0, 2)")
    return plain.unionByName(W.rect_cover(shapes.select("id", "p.x", "p.y"), ["id"]).select("id", "x", "y", "w", "h"))


@query("""WITH q AS (SELECT id, unnest([{'x': x, 'y': y - 1, 'w': 2 * w + 1, 'h': 2}, {'x': x + 2 * w - 1, 'y': y - 1, 'w': 2, 'h': 4 * h + 1}]) AS r FROM v_rects),
  s AS (SELECT DISTINCT id, x, unnest(range(y, y + h)) AS y FROM (SELECT id, unnest(range(r.x, r.x + r.w)) AS x, r.y AS y, r.h AS h FROM q))
  SELECT id, CAST(count(*) AS BIGINT) AS squares, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM s GROUP BY id""")
def G4_G19_polyline_squares(spark, d):
    """Polylines with a corner and a width of two, as outlines, then as runs of squares."""
    from ..functions.buffers import buffered
    from ..operators.scanlines import column_runs

    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, far = F.col("x"), F.col("y"), F.col("x") + 2 * F.col("w")
    parts = view(spark, d, "v_rects")
    tasks = tasks_for(parts)
    shapes = parts.repartition(tasks, "id").select("id", buffered(F.array(point(x, y), point(far, y), point(far, y + 4 * F.col("h"))), F.lit(2.0)).alias("ring"))
    n = F.col("length")
    return column_runs(shapes, ["id"], tasks=tasks).groupBy("id").agg(F.sum(n).alias("squares"), F.sum(F.col("x") * n).alias("sum_x"), F.sum(F.expr("(start + start + length - 1) * length div 2")).alias("sum_y"))
