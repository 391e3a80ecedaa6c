"""What overlapping rectangles cover, without their pairs: overlap, components, hidden edges.

Rectangles (x, y, w, h, whole numbers) become rows of columns or squares, which are combined where they are before they
are shuffled. However many lie on one place, it has one row afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import reliable
from .joins import components, spread

_REAL = "coalesce(w > 0 AND h > 0 AND x + y IS NOT NULL, false)"


def _columns(rects: DataFrame, keep: list[str], last: str = "x + w - 1") -> DataFrame:
    """A row (keep, x, y, h) for each column of squares up to `last`; rectangles without area have none."""
    return spread(rects.filter(_REAL)).select(*keep, F.explode(F.sequence(F.col("x"), F.expr(last))).alias("x"), "y", "h")


def _self_overlap(rects: DataFrame, by: list[str]) -> DataFrame:
    """(by, overlap): area that pairs of rows of a group share, from how many are open along each column."""
    ends = F.explode(F.array(F.struct(F.col("y").alias("at"), F.lit(1).alias("d")), F.struct((F.col("y") + F.col("h")).alias("at"), F.lit(-1).alias("d"))))
    steps = _columns(rects, by).select(*by, "x", ends.alias("s")).groupBy(*by, "x", "s.at").agg(F.sum("s.d").alias("d"))
    order = Window.partitionBy(*by, "x").orderBy("at")
    runs = steps.select(*by, F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), (F.lead("at").over(order) - F.col("at")).alias("length"))
    return runs.groupBy(*by).agg(F.sum(F.expr("n * (n - 1) div 2 * length")).alias("overlap"))


def total_overlap(rects: DataFrame, by: list[str], key: str = "id") -> DataFrame:
    """(by, overlap) of each group: the area that its pairs of rectangles of different `key` share (A22); groups without any have no row."""
    rows = rects.select(key, *by, "x", "y", "w", "h").dropna(subset=[key, *by])
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key)
    same = _self_overlap(rows.join(again, key, "left_semi"), [key, *by]).select(*by, (-F.col("overlap")).alias("overlap"))
    return _self_overlap(rows, by).unionByName(same).groupBy(*by).agg(F.sum("overlap").alias("overlap")).filter("overlap > 0")


def overlap_components(rects: DataFrame, by: list[str]) -> DataFrame:
    """(id, component) of rectangles that share area within a group, directly or through others.

    Rectangles of a column whose runs overlap are an island. A rectangle is in one island of each of its columns, so that
    neighbouring columns' islands hang together if a rectangle begins at one row of both. Islands are called by their least
    id, and components are found over islands alone.
    """
    rows = rects.select("id", *by, "x", "y", "w", "h").filter("id is not null")
    whole = F.expr(_REAL)
    for b in by:
        whole = whole & F.col(b).isNotNull()
    real = rows.filter(whole)
    columns = spread(real).select("id", *by, F.explode(F.sequence(F.col("x"), F.expr("x + w - 1"))).alias("c"), "y", (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("end"))
    starts = columns.groupBy(*by, "c", "y").agg(F.max("end").alias("end"), F.min("id").alias("least"), F.max(F.col("right") - F.col("c")).alias("left"))
    order = Window.partitionBy(*by, "c").orderBy("y")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = starts.withColumn("opens", F.when(before > F.col("y"), 0).otherwise(1))
    islands = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    places = reliable(islands.select(*by, "c", "y", (F.col("left") > 1).alias("goes_on"), F.min("least").over(Window.partitionBy(*by, "c", "island")).alias("rep")))
    key = [*by, "c", "y"]
    following = places.select(*by, (F.col("c") - 1).alias("c"), "y", F.col("rep").alias("next"))
    edges = places.filter("goes_on").join(following, key).filter("rep <> next").select(F.col("rep").alias("a"), F.col("next").alias("b")).distinct()
    own = real.join(places.withColumnRenamed("c", "x"), [*by, "x", "y"]).select("id", "rep").union(rows.filter(~whole).select("id", F.col("id").alias("rep")))
    named = reliable(own.groupBy("id").agg(F.min("rep").alias("rep"), F.collect_set("rep").alias("reps")))  # an id has one rectangle, or a few
    again = named.filter(F.size("reps") > 1).select(F.col("rep").alias("a"), F.explode("reps").alias("b")).filter("a <> b")
    nodes = places.select(F.col("rep").alias("id")).union(named.select(F.explode("reps")))  # some islands have no rectangle's first column
    found = components(nodes.distinct(), edges.union(again))
    return named.select("id", "rep").join(found.withColumnRenamed("id", "rep"), "rep").select("id", "component")


def hidden_edges(rects: DataFrame, by: list[str]) -> DataFrame:
    """(id, hidden): how much of each rectangle's right edge others of its group cover, borders too.

    A square's side is hidden if the least or the greatest id that lies on it is another's; edges without any have no row.
    """
    rows = rects.select("id", *by, "x", "y", "w", "h").dropna()
    ys = F.explode(F.sequence(F.col("y"), F.expr("y + h - 1"))).alias("y")
    lines = spread(rows.filter("w >= 0 and h > 0")).select("id", *by, F.explode(F.sequence(F.col("x"), F.expr("x + w"))).alias("line"), "y", "h")
    sides = lines.select("id", *by, "line", ys).groupBy(*by, "line", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    edges = spread(rows.filter("h > 0")).select("id", *by, (F.col("x") + F.col("w")).alias("line"), ys)
    return edges.join(sides.hint("merge"), [*by, "line", "y"]).filter("id <> lo or id <> hi").groupBy("id").agg(F.count_distinct("y").alias("hidden"))
