"""Order-dependent operators as windows: runs, interval unions, sweeps, covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, by: list[str]) -> DataFrame:
    """Union of touching or overlapping intervals (s, e) in each group."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("opens", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    island = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def gaps(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """What a group's whole interval [start, end) has besides the union of its intervals (s, e)."""
    merged = merge_intervals(df, [*by, start, end])
    order = Window.partitionBy(*by, start, end).orderBy("s")
    rows = merged.withColumn("next", F.coalesce(F.lead("s").over(order), F.col(end))).withColumn("first", F.row_number().over(order) == 1)
    parts = F.array(F.when(F.col("first"), F.struct(F.col(start).alias("s"), F.least("s", end).alias("e"))), F.struct(F.greatest("e", start).alias("s"), F.least("next", end).alias("e")))
    return rows.select(*by, F.explode(F.array_compact(parts)).alias("g")).select(*by, "g.*").filter("s < e")


def runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive distinct integers in each group: start and length."""
    order = Window.partitionBy(*by).orderBy(value)
    island = df.select(*by, value).distinct().withColumn("island", F.col(value) - F.row_number().over(order))
    return island.groupBy(*by, "island").agg(F.min(value).alias("start"), F.count("*").alias("length")).drop("island")


def rect_cover(squares: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Disjoint rectangles (x, y, w, h) that cover a set of squares: runs in columns, then equal neighbouring columns.

    Columns only join if all of their runs are equal, as one strip.
    """
    by = by or []
    return strips(runs(squares, [*by, "x"], "y"), by)


def strips(runs_: DataFrame, by: list[str]) -> DataFrame:
    """Rectangles (x, y, w, h) of vertical runs (x, start, length): neighbouring columns with equal runs as one strip."""
    columns = runs_.groupBy(*by, "x").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("slots"))
    order = Window.partitionBy(*by, "slots").orderBy("x")
    joined = columns.withColumn("island", F.col("x") - F.row_number().over(order)).groupBy(*by, "slots", "island").agg(F.min("x").alias("x"), F.count("*").alias("w"))
    return joined.select(*by, "x", F.explode("slots").alias("s"), "w").select(*by, "x", F.col("s.start").alias("y"), "w", F.col("s.length").alias("h"))


def fill_runs(values: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Runs of equal values over consecutive positions, bridging unset (null) positions between equal ones.

    Null is the wildcard: nulls between two equal values belong to their run; nulls at a run's end don't.
    """
    order = Window.partitionBy(*by).orderBy(at)
    known = values.filter(F.col(value).isNotNull())
    change = F.when(F.lag(value).over(order).eqNullSafe(F.col(value)), 0).otherwise(1)
    island = known.withColumn("_c", change).withColumn("_i", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_i", value).agg(F.min(at).alias("start"), (F.max(at) - F.min(at) + 1).alias("length")).drop("_i")


def first_of(df: DataFrame, by: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each group."""
    keys = [F.col(o).desc() if last else F.col(o).asc() for o in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).filter("_n = 1").drop("_n")


def sweep_cost(df: DataFrame, by: list[str]) -> DataFrame:
    """Sum over intervals of how many others are open where they start."""
    events = df.select(*by, F.col("s").alias("at"), F.lit(1).alias("open")).union(df.select(*by, F.col("e"), F.lit(-1)))
    # ends come before starts at one place
    order = Window.partitionBy(*by).orderBy("at", "open").rowsBetween(Window.unboundedPreceding, -1)
    active = events.withColumn("active", F.coalesce(F.sum("open").over(order), F.lit(0)))
    return active.filter("open = 1").groupBy(*by).agg(F.sum("active").alias("cost"))


def slices(df: DataFrame, n: int, order: list, by: list[str] | None = None) -> DataFrame:
    """Slice numbers 1 to n of an ordered list, larger slices first."""
    return df.withColumn("slice", F.ntile(n).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
