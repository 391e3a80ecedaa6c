"""The mark store: loading, viewport queries, filters, top-k, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import GRID_ROWS_PER_LAYER, col, morton

SCHEMA = "id string, type string, name string, desc string, layer int, visible_zoom_level int, color string, x double, y double, rects array<struct<x:double,y:double,width:double,height:double>>, points array<struct<x:double,y:double>>, width double"


def load(lines: DataFrame, column: str = "value") -> DataFrame:
    """Marks from JSON texts: defaults filled in, ids from content where missing, invalid marks dropped."""
    m = lines.select(F.from_json(column, SCHEMA).alias("m")).select("m.*")
    m = m.withColumns({"layer": F.coalesce("layer", F.lit(0)), "visible_zoom_level": F.coalesce("visible_zoom_level", F.lit(0)), "name": F.coalesce("name", F.lit("")), "desc": F.coalesce("desc", F.lit(""))})
    content = F.xxhash64("type", "name", "desc", "layer", "x", "y", "rects", "points")
    return m.withColumn("id", F.coalesce("id", F.hex(content))).filter(valid())


def valid() -> Column:
    """Whether a mark has what its type needs."""
    point = F.col("x").isNotNull() & F.col("y").isNotNull()
    area = (F.size("rects") > 0) & F.forall("rects", lambda r: (r["width"] > 0) & (r["height"] > 0) & r["x"].isNotNull() & r["y"].isNotNull())
    line = (F.size("points") >= 2) & F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.coalesce(F.when(F.col("type").isin("point", "text"), point).when(F.col("type") == "area", area).when(F.col("type").isin("polygon", "polyline"), line), F.lit(False))


def boxed(marks: DataFrame) -> DataFrame:
    """Adds bounding boxes in squares (x1..y2) and in difference and sum (d1..s2) of rectangles x, y, w, h."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    return marks.withColumns({"x1": x, "y1": y, "x2": x + w, "y2": y + h, "d1": x - y - h, "d2": x + w - y, "s1": x + y, "s2": x + w + y + h})


def laid_out(marks: DataFrame, path: str, files: int) -> None:
    """Writes marks by layer and zoom, near ones in one file: windows prune by partitions and by Parquet statistics.

    Takes the place of a tree: a Z-order key ranges rows into files whose boxes hardly overlap.
    """
    key = morton(F.col("x1").cast("bigint") + (1 << 20), F.col("y1").cast("bigint") + (1 << 20))
    ordered = marks.withColumn("_z", key).repartitionByRange(files, "layer", "visible_zoom_level", "_z").sortWithinPartitions("layer", "visible_zoom_level", "_z").drop("_z")
    ordered.write.partitionBy("layer", "visible_zoom_level").mode("overwrite").parquet(path)


def in_window(window: tuple, iso: bool = False, closed: bool = True) -> Column:
    """Whether a boxed mark meets a window; the iso view moves sums by its layer."""
    lo_x, lo_y, hi_x, hi_y = window
    if iso:
        shift = F.col("layer") * GRID_ROWS_PER_LAYER
        a, b, c, d = F.col("d1"), F.col("d2"), F.col("s1") - shift, F.col("s2") - shift
    else:
        a, b, c, d = F.col("x1"), F.col("x2"), F.col("y1"), F.col("y2")
    if closed:
        return (b >= lo_x) & (a <= hi_x) & (d >= lo_y) & (c <= hi_y)
    return (b > lo_x) & (a < hi_x) & (d > lo_y) & (c < hi_y)


def viewport(marks: DataFrame, window: tuple, layer: int, zoom: int, limit: int = 256, top_zoom: int = 3, iso: bool = False) -> DataFrame:
    """Marks of a layer that the zoom level shows in a window; if more than `limit` and not at the top zoom, the nearest to the middle.

    Ties in distance go to the lesser id; limit 0 is none. Whether the limit applies is known only after the filter:
    limit + 1 rows tell, and the limit itself is no change where there are no more.
    """
    found = marks.filter((F.col("layer") == layer) & (F.col("visible_zoom_level") <= zoom) & in_window(window, iso))
    if not limit or zoom >= top_zoom:
        return found
    return nearest(found, ((window[0] + window[2]) / 2, (window[1] + window[3]) / 2), limit)


def nearest(marks: DataFrame, at: tuple, k: int) -> DataFrame:
    """The k marks whose middles are nearest."""
    dx, dy = (F.col("x1") + F.col("x2")) / 2 - at[0], (F.col("y1") + F.col("y2")) / 2 - at[1]
    return marks.withColumn("_d", dx * dx + dy * dy).orderBy("_d", "id").limit(k).drop("_d")


def top_of_groups(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """Best k rows of each group (T3); Spark limits groups before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def covered(marks: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, hidden: tuple[str, ...] = (), without: tuple = ()) -> DataFrame:
    """Marks (id, type, x, y, w, h) of types not hidden, whose box shares area with an included rectangle and is not
    wholly covered by the excluded ones, which are disjoint (F8)."""
    from .joins import spread
    from .quadtree import rect_pairs, related_keys

    out = marks.filter(~F.col("type").isin(*hidden) & ~F.col("id").isin(*without)) if hidden or without else marks
    area = lambda: F.greatest(F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest("a.x", "b.x"), F.lit(0)) * F.greatest(F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) - F.greatest("a.y", "b.y"), F.lit(0))
    base = out  # both conditions look at the marks themselves, so that neither is computed again for the other
    if include is not None:
        out = out.join(related_keys(spread(base.select("id", *"xywh")), spread(include.select(*"xywh")), "id", "open"), "id", "left_semi")
    if exclude is not None:
        lost = rect_pairs(spread(base.select("id", *"xywh")), exclude.select(*"xywh"), "open").withColumn("shared", area()).groupBy(F.col("a.id").alias("id"), F.col("a.w").alias("w"), F.col("a.h").alias("h")).agg(F.sum("shared").alias("shared"))
        out = out.join(lost.filter(F.col("shared") == F.col("w") * F.col("h")).select("id"), "id", "left_anti")
    return out


def upserted(marks: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """marks with changed rows in place of the old, new rows added."""
    return marks.join(changes.select(key), key, "left_anti").unionByName(changes)


def deleted(marks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """marks without the listed ids (D3)."""
    return marks.join(ids.select(key), key, "left_anti")


def exported(marks: DataFrame, defaults: dict) -> DataFrame:
    """JSON of each mark without columns at their defaults."""
    kept = [F.nullif(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in sorted(marks.columns)]
    return marks.select("id", F.to_json(F.struct(*kept)).alias("json"))


def moved(rects, index: int, dx, dy) -> Column:
    """Rectangles of an area with one moved."""
    return F.transform(rects, lambda r, i: F.when(i == index, F.struct((r["x"] + dx).alias("x"), (r["y"] + dy).alias("y"), r["w"].alias("w"), r["h"].alias("h"))).otherwise(r))


def resized(rects, index: int, w, h) -> Column:
    """Rectangles of an area with one at another size, at least one square."""
    one = F.lit(1).cast("bigint")
    return F.transform(rects, lambda r, i: F.when(i == index, F.struct(r["x"].alias("x"), r["y"].alias("y"), F.greatest(w, one).alias("w"), F.greatest(h, one).alias("h"))).otherwise(r))


def without_rect(rects, index: int) -> Column:
    """Rectangles of an area without one; an area keeps its last."""
    return F.when(F.size(rects) > 1, F.filter(rects, lambda r, i: i != index)).otherwise(col(rects))
