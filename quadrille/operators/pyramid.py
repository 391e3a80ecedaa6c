"""Numeric and colour roll-ups: pyramids, heat blocks, square colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import floor_div, parent


#: Levels of a pyramid that are made in one step: blocks of 4^STEP squares lie in one task.
STEP = 5


def pyramid(points: DataFrame, levels: int, sums: tuple[str, ...] = ("v",), maxima: tuple[str, ...] = ("v",)) -> DataFrame:
    """n, sums and maxima of points (layer, x, y) by (level, layer, tx, ty), for levels 0 to `levels`.

    Points are aggregated to squares once. Squares are dealt by blocks, in which STEP levels are made without another
    shuffle; the next levels are made of the blocks' tops in the same way, so that each step shuffles 1/1024 of the last.
    """
    shift = lambda c, k: F.call_function("shiftright", F.col(c), k)
    whole = lambda: [F.sum("n").alias("n"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums), *(F.max(f"max_{c}").alias(f"max_{c}") for c in maxima)]
    squares = points.groupBy("layer", "x", "y").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.max(c).alias(f"max_{c}") for c in maxima))
    names = ["layer", "tx", "ty", *squares.columns[3:]]
    below, done, out = squares.toDF(*names), 0, None
    while True:
        up = min(STEP, levels - done)
        block = ["layer", "bx", "by"]
        rows = below.withColumn("bx", shift("tx", F.lit(STEP))).withColumn("by", shift("ty", F.lit(STEP))).repartition(*block)
        rows = rows.withColumn("k", F.explode(F.sequence(F.lit(min(done, 1)), F.lit(up))))
        rows = rows.withColumn("tx", shift("tx", F.col("k"))).withColumn("ty", shift("ty", F.col("k")))
        own = rows.groupBy(*block, "k", "tx", "ty").agg(*whole())
        part = own.select((F.col("k") + done).alias("level"), *names)
        out = part if out is None else out.union(part)
        done += up
        if done == levels:
            return out
        below = own.filter(F.col("k") == up).select(*names)


def heat_blocks(points: DataFrame, block: int = 8) -> DataFrame:
    """Population 0 to 255 of each block that has points (S6's grid from points)."""
    return points.groupBy("layer", floor_div("x", block).alias("bx"), floor_div("y", block).alias("by")).agg(F.least(F.lit(255), F.count("*")).cast("bigint").alias("z"))


def colour_sums(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Sums of opaque pixels (alpha 255) of each texture; without any, black once (A1)."""
    opaque = F.col("a") == 255
    parts = [F.coalesce(F.sum(F.when(opaque, F.col(c))), F.lit(0)).cast("bigint").alias(f"sum_{c}") for c in "rgb"]
    return pixels.groupBy(*by).agg(*parts, F.greatest(F.count_if(opaque), F.lit(1)).alias("n"))


def mean_colour() -> list[Column]:
    """Aggregates: mean of colour sums, rounded down (A2)."""
    return [floor_div(F.sum(f"sum_{c}"), F.sum("n")).alias(c) for c in "rgb"]


def square_colours(stacks: DataFrame, textures: DataFrame, how: str, water: tuple[str, ...] = ()) -> DataFrame:
    """Colour of each square from its stack (square, pos, tile) and textures' colour sums (A3-A5).

    `first` takes the lowest tile, `water` also the lowest tile above it that is in `water`, `mean` all tiles. Tiles
    without texture count nothing.
    """
    if how == "mean":
        chosen = stacks
    elif how == "first":
        chosen = stacks.filter("pos = 0")
    else:  # both tiles in one pass over a square's stack
        above = F.when((F.col("pos") > 0) & F.col("tile").isin(*water), F.col("pos"))
        both = stacks.groupBy("square").agg(F.min_by("tile", F.when(F.col("pos") == 0, F.col("pos"))).alias("a"), F.min_by("tile", above).alias("b"))
        chosen = both.select("square", F.explode(F.array_compact(F.array("a", "b"))).alias("tile"))
    return chosen.join(textures, "tile").groupBy("square").agg(*mean_colour())


def stale_ancestors(tiles: DataFrame, levels: int) -> DataFrame:
    """Tiles (level, tx, ty) and everything above them, counted upwards."""
    up = tiles.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    shift = lambda c: F.call_function("shiftright", F.col(c), F.col("k"))
    return up.select(F.col("k").alias("level"), shift("tx").alias("tx"), shift("ty").alias("ty")).distinct()


def dependencies(pending: DataFrame) -> DataFrame:
    """How many of a tile's four children are pending."""
    return pending.groupBy(parent("tx").alias("tx"), parent("ty").alias("ty")).agg(F.count("*").alias("children"))
