"""Polygons as runs of squares, by the crossings of their edges with the middles of columns (G1, G19, G20, jobs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import rotated


def _below(y: Column) -> Column:
    """Whether the square y of a column lies before the crossing: its middle is on the lesser side of the edge.

    A middle on the edge itself goes by what is right of it, as with points in polygons: before a rising edge, behind a
    falling one.
    """
    run, rise = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    side = (run * (y + 0.5 - F.col("a.y")) - (F.col("x") + 0.5 - F.col("a.x")) * rise) * F.signum(run)
    return (side < 0) | ((side == 0) & (rise * F.signum(run) > 0))


def column_runs(shapes: DataFrame, by: list[str], ring: str = "ring", tasks: int | None = None) -> DataFrame:
    """(by, x, start, length): vertical runs of the squares whose middles are inside a ring of points, by non-zero winding.

    An edge is dealt to the columns that it crosses, so that rows are as many as the outline is wide, not as the shape is
    large. Sorted by place, what edges add up to says where the inside begins and ends; all steps share one shuffle, to as
    many tasks as are given.
    """
    edges = shapes.select(*by, F.explode(F.arrays_zip(F.col(ring).alias("a"), rotated(ring).alias("b"))).alias("e")).select(*by, "e.a", "e.b").filter("a.x <> b.x")
    first = lambda v: F.ceil(v - 0.5)
    low, high = F.least("a.x", "b.x"), F.greatest("a.x", "b.x")
    crossed = edges.filter(first(low) < first(high)).withColumn("x", F.explode(F.sequence(first(low), first(high) - 1)))
    at = F.col("a.y") + (F.col("x") + 0.5 - F.col("a.x")) * (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    guess = crossed.withColumn("k", first(at))  # may be rounded to a neighbour, which the edge itself sets right
    exact = F.when(~_below(F.col("k") - 1), F.col("k") - 1).when(_below(F.col("k")), F.col("k") + 1).otherwise(F.col("k"))
    steps = guess.select(*by, "x", exact.alias("k"), F.when(F.col("b.x") > F.col("a.x"), 1).otherwise(-1).alias("s"))
    turns = steps.repartition(*([tasks] if tasks else []), *by, "x").groupBy(*by, "x", "k").agg(F.sum("s").alias("s")).filter("s <> 0")
    order = Window.partitionBy(*by, "x").orderBy("k")
    inside = turns.withColumn("inside", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)) != 0)
    change = inside.withColumn("was", F.lag("inside", 1, False).over(order)).filter("inside <> was")
    return change.withColumn("end", F.lead("k").over(order)).filter("inside").select(*by, "x", F.col("k").alias("start"), (F.col("end") - F.col("k")).alias("length"))
