"""Borders of square sets and polygons around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import reliable

# directions: north, east, south, west
SIDES = (("n", 0, -1), ("e", 1, 0), ("s", 0, 1), ("w", -1, 0))


def border_flags(squares: DataFrame, by: list[str]) -> DataFrame:
    """Squares with a side that borders on the outside, and for each side whether its neighbour is inside.

    Every square announces itself to its four neighbours, and one grouping by place collects what was announced: a
    single shuffle instead of four self joins.
    """
    told = F.array(F.struct(F.lit("self").alias("side"), F.col("x").alias("x"), F.col("y").alias("y")), *(F.struct(F.lit(s).alias("side"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for s, dx, dy in SIDES))
    rows = squares.select(*by, F.explode(told).alias("t")).select(*by, "t.*")
    seen = rows.groupBy(*by, "x", "y").agg(F.bool_or(F.col("side") == "self").alias("own"), *(F.bool_or(F.col("side") == s).alias(s) for s, _, _ in SIDES))
    return seen.filter("own and not (n and e and s and w)").drop("own")


def edge_segments(flags: DataFrame, by: list[str], w: int, h: int, pad_x: int, pad_y: int) -> DataFrame:
    """A segment for each open side, set in by the padding, run on into inside neighbours.

    Sides run clockwise; where the side before or after is open too, the end stays within the padding.
    """
    left, right, top, bottom = F.col("x") * w, (F.col("x") + 1) * w, F.col("y") * h, (F.col("y") + 1) * h
    run = lambda side, pad: F.when(F.col(side), pad).otherwise(-pad)
    shapes = {
        "n": (left - run("w", pad_x), top + pad_y, right + run("e", pad_x), top + pad_y),
        "e": (right - pad_x, top - run("n", pad_y), right - pad_x, bottom + run("s", pad_y)),
        "s": (right + run("e", pad_x), bottom - pad_y, left - run("w", pad_x), bottom - pad_y),
        "w": (left + pad_x, bottom + run("s", pad_y), left + pad_x, top - run("n", pad_y)),
    }
    parts = F.array(*(F.when(~F.col(s), F.struct(F.lit(s).alias("side"), *(v.cast("bigint").alias(n) for v, n in zip(shape, ("x1", "y1", "x2", "y2"), strict=True)))) for s, shape in shapes.items()))
    return flags.select(*by, "x", "y", F.explode(F.array_compact(parts)).alias("e")).select(*by, "x", "y", "e.*")


#: Sides in clockwise order: the way a side runs, and where its outside is (fixed by the directions above).
_RUNS = ((1, 0), (0, 1), (-1, 0), (0, -1))
_OUTSIDE = tuple((dx, dy) for _, dx, dy in SIDES)


def edges(squares: DataFrame, by: list[str]) -> DataFrame:
    """(by, edge, next) of the unit sides of squares that border on the outside, inside on their right.

    An edge is (y, x, side) of its square, sides counted clockwise from north. The next one turns right where it can, so
    that rings which touch at a corner don't cross; it is known from the eight squares around, which announce themselves
    in one shuffle, so that edges needn't be joined by their ends.
    """
    around = [(0, 0), *((dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy)]
    told = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for k, (dx, dy) in enumerate(around)))
    rows = squares.select(*by, F.explode(told).alias("t")).select(*by, "t.*")
    seen = rows.groupBy(*by, "x", "y").agg(*(F.bool_or(F.col("k") == k).alias(f"at{k}") for k in range(9))).filter("at0")
    at = lambda dx, dy: F.col(f"at{around.index((dx, dy))}")
    place = lambda dx, dy, side: F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(side).alias("side"))
    parts = []
    for side, ((dx, dy), (ox, oy)) in enumerate(zip(_RUNS, _OUTSIDE, strict=True)):
        after = F.when(~at(dx, dy), place(0, 0, (side + 1) % 4)).when(~at(dx + ox, dy + oy), place(dx, dy, side)).otherwise(place(dx + ox, dy + oy, (side + 3) % 4))
        parts.append(F.when(~at(ox, oy), F.struct(place(0, 0, side).alias("edge"), after.alias("next"))))
    return seen.select(*by, F.explode(F.array_compact(F.array(*parts))).alias("e")).select(*by, "e.*")


def ring_order(chain: DataFrame, by: list[str]) -> DataFrame:
    """chain (by, edge, next) with each edge's ring, named by its least edge, and place in it, from 0.

    Pointer doubling: in each round an edge looks as far again as it did before, and keeps the least edge in sight and how
    far that is. When a round finds nothing less anywhere, all have seen the whole of their rings. Rounds are joins
    of all edges, as many as the logarithm of the longest ring; no ring or group is gathered.
    """
    now = reliable(chain.select(*by, "edge", F.col("next").alias("to"), F.col("edge").alias("least"), F.lit(0).cast("bigint").alias("far")))
    step = 1
    while True:
        there = now.select(*by, F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("far").alias("far2"))
        less = F.col("least2") < F.col("least")
        now = reliable(now.join(there, [*by, "to"]).select(*by, "edge", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), F.when(less, F.col("far2") + step).otherwise(F.col("far")).alias("far"), less.alias("less")))
        step *= 2
        if now.filter("less").isEmpty():
            break
    size = now.groupBy(*by, "least").agg(F.count("*").alias("n"))
    rows = now.join(size, [*by, "least"]).select(*by, "edge", F.col("least").alias("ring"), ((F.col("n") - F.col("far")) % F.col("n")).alias("pos"))
    return rows.join(chain, [*by, "edge"])


def ring_corners(squares: DataFrame, by: list[str]) -> DataFrame:
    """(by, outer, ring, kind, pos, x, y): the corners of all rings around the squares of each group.

    Rings run clockwise around squares and the other way around holes, from their least edge on; pos rises along a ring.
    outer is the ring around the component that a hole is in, and an outer ring's own name. A group may have any number
    of components. Which ring a hole lies in is told by the border above it: the squares over a hole's top edge reach up
    to an edge of the outer ring or of a higher hole, which is followed in turn.
    """
    ordered = reliable(ring_order(edges(squares, by), by))
    x1, y1 = F.col("edge.x") + F.when(F.col("edge.side").isin(1, 2), 1).otherwise(0), F.col("edge.y") + F.when(F.col("edge.side").isin(2, 3), 1).otherwise(0)
    run = lambda axis: F.element_at(F.array(*(F.lit(r[axis]) for r in _RUNS)), F.col("edge.side") + 1)
    area = ordered.groupBy(*by, "ring").agg(F.sum(x1 * run(1) - y1 * run(0)).alias("twice"))
    kinds = area.select(*by, "ring", F.when(F.col("twice") > 0, "outer").otherwise("hole").alias("kind"))
    # of each column, the borders to the north and the top edges of holes from top to bottom: a hole's last border is above it
    north = ordered.filter("edge.side = 0").select(*by, F.col("edge.x").alias("x"), F.col("edge.y").alias("y"), F.lit(0).alias("k"), F.col("ring").alias("above"), F.lit(None).cast(ordered.schema["ring"].dataType).alias("ring"))
    tops = kinds.filter("kind = 'hole'").select(*by, F.col("ring.x").alias("x"), F.col("ring.y").alias("y"), F.lit(1).alias("k"), F.lit(None).cast(ordered.schema["ring"].dataType).alias("above"), "ring")
    column = Window.partitionBy(*by, "x").orderBy("y", "k")
    above = north.unionByName(tops).withColumn("above", F.last("above", ignorenulls=True).over(column)).filter("ring is not null").select(*by, "ring", "above")
    root = kinds.filter("kind = 'outer'").select(*by, "ring", F.col("ring").alias("outer"))
    open_ = reliable(above)
    while not open_.isEmpty():  # as many rounds as the logarithm of the longest way up over holes
        met = open_.join(root.select(*by, F.col("ring").alias("above"), "outer"), [*by, "above"], "left")
        root = reliable(root.unionByName(met.filter("outer is not null").select(*by, "ring", "outer")))
        rest = met.filter("outer is null").drop("outer")
        hop = open_.select(*by, F.col("ring").alias("above"), F.col("above").alias("further"))
        open_ = reliable(rest.join(hop, [*by, "above"], "left").select(*by, "ring", F.coalesce("further", "above").alias("above")))
    turns = ordered.filter("edge.side <> next.side").select(*by, "ring", "pos", (x1 + run(0)).alias("x"), (y1 + run(1)).alias("y"))
    return turns.join(kinds, [*by, "ring"]).join(root, [*by, "ring"]).select(*by, "outer", "ring", "kind", "pos", "x", "y")


def polygons(squares: DataFrame, by: list[str]) -> DataFrame:
    """Rings of `ring_corners` as arrays of points, a row for each ring."""
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ring_corners(squares, by).groupBy(*by, "outer", "ring", "kind").agg(points.alias("points"))  # the corners of one ring


def outlines(rings: DataFrame, by: list[str]) -> DataFrame:
    """(by, outer, path): an SVG path of each outer ring with its holes, whose other direction leaves them unfilled."""
    line = F.concat(F.lit("M"), F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"], p["y"])), "L"), F.lit("Z"))
    parts = rings.select(*by, "outer", F.struct((F.col("kind") == "hole").alias("hole"), "ring", line.alias("line")).alias("p"))
    return parts.groupBy(*by, "outer").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["line"]), "").alias("path"))


def disjoint_cover(rects: DataFrame, by: list[str]) -> DataFrame:
    """Disjoint rectangles over the same area as overlapping ones, in few strips.

    Edges cut each group's area into cells of a compressed grid; covered cells are joined in columns or in rows, whichever gives fewer
    strips, then fewer rectangles.
    """
    from .windows import rect_cover

    # unit squares would be as many as the area: positions are numbered by their rank among the edges
    xs = rects.select(*by, F.explode(F.array("x", F.col("x") + F.col("w"))).alias("v")).distinct()
    ys = rects.select(*by, F.explode(F.array("y", F.col("y") + F.col("h"))).alias("v")).distinct()
    x_list = xs.groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("xs"))  # edges of one group
    y_list = ys.groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias("ys"))
    at = lambda a, v: F.array_position(F.col(a), v)
    own = rects.join(x_list, by).join(y_list, by)
    cells = own.select(*by, F.explode(F.sequence(at("xs", F.col("x")), at("xs", F.col("x") + F.col("w")) - 1)).alias("x"), at("ys", F.col("y")).alias("y0"), (at("ys", F.col("y") + F.col("h")) - 1).alias("y1"))
    cells = cells.select(*by, "x", F.explode(F.sequence("y0", "y1")).alias("y")).distinct()
    by_column = rect_cover(cells, by).withColumn("way", F.lit(0))
    by_row = rect_cover(cells.select(*by, F.col("y").alias("x"), F.col("x").alias("y")), by).select(*by, F.col("y").alias("x"), F.col("x").alias("y"), F.col("h").alias("w"), F.col("w").alias("h"), F.lit(1).alias("way"))
    both = by_column.unionByName(by_row)
    cost = both.groupBy(*by, "way").agg(F.when(F.col("way") == 0, F.count_distinct("x", "w")).otherwise(F.count_distinct("y", "h")).alias("strips"), F.count("*").alias("n"))
    best = cost.groupBy(*by).agg(F.min_by("way", F.struct("strips", "n", "way")).alias("way"))
    chosen = both.join(best, [*by, "way"]).join(x_list, by).join(y_list, by)
    edge = lambda a, v: F.element_at(F.col(a), v.cast("int"))
    x1, y1 = edge("xs", F.col("x")), edge("ys", F.col("y"))
    return chosen.select(*by, x1.alias("x"), y1.alias("y"), (edge("xs", F.col("x") + F.col("w")) - x1).alias("w"), (edge("ys", F.col("y") + F.col("h")) - y1).alias("h"))
