"""Geometry as column expressions (G1-G9, G11, G17-G29 building blocks, P17-P21).

Points are structs (x, y), polygons arrays of them, rectangles structs or columns (x, y, w, h), half-open unless said.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coords import affected_margin, col, floor_div, render_margin, to_grid


def array_to_points(flat) -> Column:
    """[x0, y0, x1, y1, ...] to points; an odd last element is dropped."""
    flat = col(flat)
    n = floor_div(F.size(flat), 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(flat, i * 2).alias("x"), F.get(flat, i * 2 + 1).alias("y")))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def bounds(points) -> Column:
    """Bounding box of points."""
    xs, ys = F.transform(col(points), lambda p: p["x"]), F.transform(col(points), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def extent(points) -> Column:
    """Square rectangle of a polygon: the box truncated below, rounded and one more above."""
    b = bounds(points)
    low = lambda v: v.cast("bigint")
    high = lambda v: (v + 0.5).cast("bigint") + 1
    return F.struct(low(b["x1"]).alias("x"), low(b["y1"]).alias("y"), (high(b["x2"]) - low(b["x1"])).alias("w"), (high(b["y2"]) - low(b["y1"])).alias("h"))


def rotated(points) -> Column:
    """Points moved on by one: the ends of a ring's edges."""
    p = col(points)
    return F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))


def in_polygon(points, x, y) -> Column:
    """Non-zero winding, half-open in y (G1)."""
    x, y = col(x), col(y)

    def turn(a: Column, b: Column) -> Column:
        left = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        up, down = (a["y"] <= y) & (b["y"] > y) & (left > 0), (b["y"] <= y) & (a["y"] > y) & (left < 0)
        return F.when(up, 1).when(down, -1).otherwise(0)

    winding = F.aggregate(F.zip_with(col(points), rotated(points), turn), F.lit(0), lambda s, v: s + v)
    return (F.size(col(points)) > 1) & (winding != 0)


def even_odd(rings, x, y) -> Column:
    """Even-odd over an outer ring and its holes, half-open in x."""
    x, y = col(x).cast("double"), col(y).cast("double")

    def hits(ring: Column) -> Column:
        def hit(a: Column, b: Column) -> Column:
            inside = (a["x"] != b["x"]) & (x >= F.least(a["x"], b["x"])) & (x < F.greatest(a["x"], b["x"]))
            at = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / F.when(a["x"] == b["x"], 1).otherwise(b["x"] - a["x"])
            return F.when(inside & (y < at), 1).otherwise(0)

        return F.aggregate(F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), hit), F.lit(0), lambda s, v: s + v)

    return F.pmod(F.aggregate(F.transform(col(rings), hits), F.lit(0), lambda s, v: s + v), F.lit(2)) == 1


def in_rect(px, py, x, y, w, h) -> Column:
    """Half-open on both axes."""
    px, py, x, y = col(px), col(py), col(x), col(y)
    return (px >= x) & (px < x + col(w)) & (py >= y) & (py < y + col(h))


def clip_segment(x0, y0, x1, y1, xmin, ymin, xmax, ymax) -> Column:
    """The part of a segment in a closed box, as a struct of both ends; null outside.

    Each side gives a bound of the segment's parameter: the largest lower and the smallest upper bound remain.
    """
    x0, y0 = col(x0).cast("double"), col(y0).cast("double")
    dx, dy = col(x1).cast("double") - x0, col(y1).cast("double") - y0
    sides = [(-dx, x0 - col(xmin)), (dx, col(xmax) - x0), (-dy, y0 - col(ymin)), (dy, col(ymax) - y0)]
    ratio = lambda p, q: q / F.when(p == 0, 1.0).otherwise(p)
    low = F.greatest(F.lit(0.0), *(F.when(p < 0, ratio(p, q)).otherwise(0.0) for p, q in sides))
    high = F.least(F.lit(1.0), *(F.when(p > 0, ratio(p, q)).otherwise(1.0) for p, q in sides))
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    return F.when(~outside & (low <= high), F.struct((x0 + low * dx).alias("xa"), (y0 + low * dy).alias("ya"), (x0 + high * dx).alias("xb"), (y0 + high * dy).alias("yb")))


def clip_segment_iso(x0, y0, x1, y1, dmin, smin, dmax, smax) -> Column:
    """Clip in (difference, sum) space, given back in squares."""
    d0, s0 = to_grid(x0, y0)
    d1, s1 = to_grid(x1, y1)
    c = clip_segment(d0, s0, d1, s1, dmin, smin, dmax, smax)
    half = lambda a, b: (c[a] + c[b]) / 2
    return F.when(c.isNotNull(), F.struct(half("ya", "xa").alias("xa"), ((c["ya"] - c["xa"]) / 2).alias("ya"), half("yb", "xb").alias("xb"), ((c["yb"] - c["xb"]) / 2).alias("yb")))


def closest_on_segment(px, py, ax, ay, bx, by) -> Column:
    """Closest point of a segment and its squared distance; a segment without length is a point."""
    px, py, ax, ay = (col(v).cast("double") for v in (px, py, ax, ay))
    ux, uy = col(bx) - ax, col(by) - ay
    length = ux * ux + uy * uy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * ux + (py - ay) * uy) / F.when(length == 0, 1.0).otherwise(length)))
    qx, qy = ax + t * ux, ay + t * uy
    return F.struct(qx.alias("x"), qy.alias("y"), ((px - qx) * (px - qx) + (py - qy) * (py - qy)).alias("d2"))


def overlap_area(a: dict, b: dict) -> Column:
    """Area that two boxes (x, y, w, h columns) share; touching boxes share none."""
    side = lambda p, s: F.greatest(F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]), F.lit(0))
    return side("x", "w") * side("y", "h")


def union_box(a: dict, b: dict) -> Column:
    """Least box around two."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))


def contains_box(a: dict, b: dict) -> Column:
    """Whether box a holds box b."""
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


#: Relations of rectangles (G9): closed touches count; without corners, one axis must share more than a point; without
#: edges, touching along a side doesn't count but a common corner does; open needs common area.
RELATIONS = ("closed", "no_corner", "no_edge", "open")


def related(a: dict, b: dict, mode: str) -> Column:
    shared = lambda p, s: F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p])
    x, y = shared("x", "w"), shared("y", "h")
    closed = (x >= 0) & (y >= 0)
    if mode == "closed":
        return closed
    if mode == "no_corner":
        return closed & ((x > 0) | (y > 0))
    if mode == "no_edge":
        return closed & (((x > 0) & (y > 0)) | ((x == 0) & (y == 0)))
    if mode == "open":
        return (x > 0) & (y > 0)
    raise ValueError(mode)


def ratio_on_edge(a, b, start, end) -> Column:
    """Interval [a, b) as shares of an edge [start, end), held to it; null if empty."""
    size = (col(end) - col(start)).cast("double")
    low = F.greatest((col(a) - col(start)) / size, F.lit(0.0))
    high = F.least((col(b) - col(start)) / size, F.lit(1.0))
    return F.when(low < high, F.struct(low.alias("a"), high.alias("b")))


def squares_of(x, y, w, h) -> Column:
    """Unit squares of a rectangle, as an array of points to explode."""
    xs = F.sequence(col(x), col(x) + col(w) - 1)
    return F.flatten(F.transform(xs, lambda i: F.transform(F.sequence(col(y), col(y) + col(h) - 1), lambda j: F.struct(i.alias("x"), j.alias("y")))))


def label_anchor() -> Column:
    """Aggregate: the square with the least x + y, ties to the least x."""
    return F.min_by(F.struct("x", "y"), F.struct((F.col("x") + F.col("y")).alias("s"), F.col("x")))


def _tile_grid(left, top, right, bottom, per_tile, origin) -> Column:
    txs = F.sequence(floor_div(left - origin[0], per_tile[0]), floor_div(right - origin[0], per_tile[0]))
    tys = F.sequence(floor_div(top - origin[1], per_tile[1]), floor_div(bottom - origin[1], per_tile[1]))
    return F.flatten(F.transform(tys, lambda ty: F.transform(txs, lambda tx: F.struct(tx.alias("tx"), ty.alias("ty")))))


def rect_tiles_rough(x, y, w, h, margin=None, per_tile=(16, 32), origin=(0, 0)) -> Column:
    """Isometric tiles that the bounding box of a square rectangle reaches."""
    m = margin or affected_margin(render_margin(False))
    x2, y2 = col(x) + col(w) - 1, col(y) + col(h) - 1
    return _tile_grid(col(x) - y2 + m[0], col(x) + col(y) + m[1], x2 - col(y) + m[2], x2 + y2 + m[3], per_tile, origin)


def octagon(x, y, w, h, margin) -> list[tuple[Column, Column]]:
    """What a square rectangle reaches in grid coordinates: its diamond, widened by the margin."""
    x, y = col(x), col(y)
    x2, y2 = x + col(w) - 1, y + col(h) - 1
    left, top, right, bottom = margin
    corners = [((x, y), (left, right), top), ((x2, y), (right, right), (top, bottom)), ((x2, y2), (right, left), bottom), ((x, y2), (left, left), (bottom, top))]
    out = []
    for (sx, sy), dxs, dys in corners:
        gx, gy = to_grid(sx, sy)
        ys = dys if isinstance(dys, tuple) else (dys, dys)
        out += [(gx + dx, gy + dy) for dx, dy in zip(dxs, ys, strict=True)]
    return out


def octagon_edges(x, y, w, h, margin) -> Column:
    """Edges of the octagon from top to bottom, as structs (x0, y0, x1, y1)."""
    ring = F.array(*(F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y")) for a, b in octagon(x, y, w, h, margin)))

    def edge(a: Column, b: Column) -> Column:
        down = a["y"] <= b["y"]
        pick = lambda p, q, k: F.when(down, p[k]).otherwise(q[k])
        return F.struct(pick(a, b, "x").alias("x0"), pick(a, b, "y").alias("y0"), pick(b, a, "x").alias("x1"), pick(b, a, "y").alias("y1"))

    return F.zip_with(ring, F.concat(F.slice(ring, 2, 7), F.slice(ring, 1, 1)), edge)


def edges_span(edges, gy0, gy1) -> Column:
    """Least and largest grid column (rounded outwards) of edges between two grid rows; null where none is there."""

    def reach(e: Column) -> Column:
        dx, dy = e["x1"] - e["x0"], F.when(e["y1"] == e["y0"], 1).otherwise(e["y1"] - e["y0"])
        n0, n1 = (F.greatest(e["y0"], gy0) - e["y0"]) * dx, (F.least(e["y1"], gy1) - e["y0"]) * dx
        flat = e["y0"] == e["y1"]
        low = F.when(flat, F.least(e["x0"], e["x1"])).otherwise(e["x0"] + floor_div(F.least(n0, n1), dy))
        high = F.when(flat, F.greatest(e["x0"], e["x1"])).otherwise(e["x0"] - floor_div(-F.greatest(n0, n1), dy))
        return F.struct(low.alias("low"), high.alias("high"))

    seen = F.transform(F.filter(col(edges), lambda e: (e["y1"] >= gy0) & (e["y0"] <= gy1)), reach)
    return F.struct(F.array_min(F.transform(seen, lambda r: r["low"])).alias("low"), F.array_max(F.transform(seen, lambda r: r["high"])).alias("high"))


def rect_tiles(df, x="x", y="y", w="w", h="h", margin=None, per_tile=(16, 32), origin=(0, 0)):
    """Rows of df with each isometric tile (tx, ty) that their square rectangle really reaches.

    Rows of tiles come from the octagon's height; in each, the edges' span gives the tiles.
    """
    m = margin or affected_margin(render_margin(False))
    ring = octagon(x, y, w, h, m)
    low, high = F.least(*(p[1] for p in ring)), F.greatest(*(p[1] for p in ring))
    rows = df.withColumn("_edges", octagon_edges(x, y, w, h, m)).withColumn("ty", F.explode(F.sequence(floor_div(low - origin[1], per_tile[1]), floor_div(high - origin[1] - 1, per_tile[1]))))
    gy0 = F.col("ty") * per_tile[1] + origin[1]
    span = F.transform(F.array(edges_span("_edges", gy0, gy0 + per_tile[1])), lambda s: F.struct(floor_div(s["low"] - origin[0], per_tile[0]).alias("a"), floor_div(s["high"] - origin[0] - 1, per_tile[0]).alias("b")))
    txs = F.flatten(F.transform(F.filter(span, lambda t: t["a"] <= t["b"]), lambda t: F.sequence(t["a"], t["b"])))
    return rows.withColumn("tx", F.explode(txs)).drop("_edges")


def rect_tiles_top(x, y, w, h, tile: int, origin=(0, 0)) -> Column:
    """Top-view tiles that a square rectangle covers."""
    return _tile_grid(col(x), col(y), col(x) + col(w) - 1, col(y) + col(h) - 1, (tile, tile), origin)


def run_segments(start, length, width: int) -> Column:
    """A run of row-major positions as rectangles: head, whole rows, tail."""
    start, length = col(start), col(length)
    x, y = F.pmod(start, F.lit(width)), floor_div(start, width)
    head = F.when(x > 0, F.least(length, width - x)).otherwise(0)
    rest, row = length - head, y + F.when(x > 0, 1).otherwise(0)
    rows, tail = floor_div(rest, width), F.pmod(rest, F.lit(width))
    rect = lambda c, *v: F.when(c, F.struct(*(col(a).cast("bigint").alias(n) for a, n in zip(v, ("x", "y", "w", "h"), strict=True))))
    return F.filter(F.array(rect(head > 0, x, y, head, 1), rect(rows > 0, 0, row, width, rows), rect(tail > 0, 0, row + rows, tail, 1)), lambda r: r.isNotNull())


def longest_visible(points, box: tuple) -> Column:
    """Middle of the longest part of a polyline's segments in a box, the first on ties; null if none is seen."""
    p = col(points)
    pairs = F.transform(F.arrays_zip(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))).alias("a"), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))).alias("b")), lambda s, i: F.struct(clip_segment(s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], *box).alias("c"), i.alias("i")))
    sized = F.transform(F.filter(pairs, lambda s: s["c"].isNotNull()), lambda s: F.struct((-((s["c"]["xb"] - s["c"]["xa"]) * (s["c"]["xb"] - s["c"]["xa"]) + (s["c"]["yb"] - s["c"]["ya"]) * (s["c"]["yb"] - s["c"]["ya"]))).alias("d"), s["i"].alias("i"), ((s["c"]["xa"] + s["c"]["xb"]) / 2).alias("x"), ((s["c"]["ya"] + s["c"]["yb"]) / 2).alias("y")))
    best = F.array_min(sized)
    return F.when(best.isNotNull(), F.struct(best["x"].alias("x"), best["y"].alias("y"), (-best["d"]).alias("d2")))


def corners(x, y, w, h) -> Column:
    """Corners of a rectangle clockwise, as a ring to clip with."""
    x, y, w, h = (col(v) for v in (x, y, w, h))
    return F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
