"""Texture lists that stand for plants, by season and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: trees in the order of their types, and which of them are evergreen
TREES = ("americanholly", "americanlinden", "canadianhemlock", "carolinasilverbell", "cockspurhawthorn", "dogwood", "easternredbud", "redmaple", "riverbirch", "virginiapine", "yellowwood")
EVERGREEN = ("americanholly", "canadianhemlock", "virginiapine")
# fixed values: rows of leaves above a tree's trunk by season
LEAVES = {"spring": 2, "summer": 3, "summer2": 4, "autumn": 5}


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _tree(kind: int, size: int, season: str, snow: bool) -> list[str]:
    """Trunk, under snow another one, and leaves; sizes from 4 are large trees with rows of two."""
    name, large = TREES[kind], size >= 4
    prefix, row = (f"e_{name}JUMBO_1_", 2) if large else (f"e_{name}_1_", 4)
    parts = [size % 4 + (row if snow else 0)]
    if not snow and season in LEAVES and name not in EVERGREEN:
        parts.append(size % 4 + row * LEAVES[season])
    return [f"{prefix}{n}" for n in parts]


def vegetation(spark: SparkSession, season: str = "summer2", snow: bool = False, flower: bool = False, large_bush: bool = False, tree_size: int = 2, jumbo_size: int = 3, jumbo_type: int = 1, ground_cover: bool = True, one_tree: int = 0) -> DataFrame:
    """name and textures (in draw order) of each plant of the maps. Options out of range are moved into it."""
    i = F.col("id")
    summer = season in ("summer", "summer2")
    pick = lambda c, v: v if c else F.lit(None).cast("string")
    bush = lambda n: _named("f_bushes_1_", n)
    grown, wide = (8, 32) if large_bush else (0, 0)
    trunk = i % 8 + grown
    bushes = F.array(bush(trunk + (16 if snow else 0)), pick(not snow and season == "spring", bush(trunk + 32)), pick(not snow and summer, bush(i + wide + 64)), pick(not snow and season == "autumn", bush(trunk + 48)), pick(not snow and flower, bush(i + wide + 80)))
    plant = lambda n: _named("d_plants_1_", n)
    row = F.floor(i % 24 / 8) * 16 + 16
    grass = F.array(pick(season == "spring", plant(i % 8)), pick(summer, plant(row + i % 8)), pick(season == "autumn", plant(i % 8 + 8)), pick(flower, plant(row + 8 + i % 8)))
    small = max(0, min(3, int(tree_size)))
    kinds = F.array(*(F.array(*map(F.lit, _tree(k, small, season, snow))) for k in range(len(TREES))))
    chosen = max(0, min(len(TREES), one_tree))
    tree = F.element_at(kinds, F.lit(chosen) if chosen else (i % len(TREES) + 1).cast("int"))
    jumbo = _tree((chosen or max(1, min(len(TREES), jumbo_type))) - 1, max(small, min(5, int(jumbo_size))), season, snow)
    none = F.array().cast("array<string>")
    parts = [
        (16, "vegetation_foliage_01_", bushes if ground_cover else none),
        (48, "vegetation_groundcover_01_", grass if ground_cover else none),
        (33, "vegetation_trees_01_", tree),
        (1, "jumbo_tree_01_", F.array(*map(F.lit, jumbo))),
    ]
    out = None
    for n, prefix, textures in parts:
        own = spark.range(n).select(_named(prefix, i).alias("name"), F.array_compact(textures).alias("textures"))
        out = own if out is None else out.union(own)
    return out
