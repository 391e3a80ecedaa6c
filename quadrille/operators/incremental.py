"""Signatures of sources, snapshot diffs, stale tiles, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import parent


def signatures(files: DataFrame, key: list[str]) -> DataFrame:
    """Latest mtime and sorted signatures of each unit."""
    return files.groupBy(*key).agg(F.max("mtime").alias("mtime"), F.array_sort(F.collect_list("sig")).alias("sigs"))


def merge_signatures(parts: DataFrame, key: list[str]) -> DataFrame:
    """Signatures of several collections as one; repeats are kept (A10)."""
    return parts.groupBy(*key).agg(F.max("mtime").alias("mtime"), F.array_sort(F.flatten(F.collect_list("sigs"))).alias("sigs"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], now, by_hash: bool = True) -> DataFrame:
    """state of each unit: appeared, deleted, changed or same, and the mtime to compare tiles with.

    Changed units count as modified at `now`, whatever their files say; without hashes unequal mtimes decide.
    """
    o = old.select(*key, F.col("mtime").alias("old_mtime"), F.col("sigs").alias("old_sigs"), F.lit(True).alias("was"))
    n = new.select(*key, F.col("mtime").alias("new_mtime"), F.col("sigs").alias("new_sigs"), F.lit(True).alias("is"))
    same = F.col("old_sigs").eqNullSafe(F.col("new_sigs")) if by_hash else F.col("old_mtime").eqNullSafe(F.col("new_mtime"))
    state = F.when(F.col("was").isNull(), "appeared").when(F.col("is").isNull(), "deleted").when(~same, "changed").otherwise("same")
    joined = o.join(n, key, "full_outer").withColumn("state", state)
    return joined.select(*key, "state", F.when(F.col("state") == "same", F.col("new_mtime")).otherwise(now).alias("mtime"))


def completed(tiles: DataFrame, key: list[str], accepted: tuple[str, ...]) -> DataFrame:
    """Earliest mtime over a tile's layers, of accepted file kinds."""
    return tiles.filter(F.col("ext").isin(*accepted)).groupBy(*key).agg(F.min("mtime").alias("mtime"))


def stale(source_tiles: DataFrame, done: DataFrame, key: list[str], eps) -> DataFrame:
    """Tiles that are missing or older than a source that reaches them by less than eps."""
    latest = source_tiles.groupBy(*key).agg(F.max("mtime").alias("source_mtime"))
    joined = latest.join(done.withColumnRenamed("mtime", "tile_mtime"), key, "left")
    return joined.filter(F.col("tile_mtime").isNull() | (F.col("tile_mtime") < F.col("source_mtime") + eps)).select(*key)


def without_skipped(tiles: DataFrame, gates: DataFrame, levels: int) -> DataFrame:
    """Tiles whose ancestor `levels` up is not among completed gate tiles."""
    up = tiles.withColumn("_gx", parent("tx", levels)).withColumn("_gy", parent("ty", levels))
    return up.join(gates.select(F.col("tx").alias("_gx"), F.col("ty").alias("_gy")), ["_gx", "_gy"], "left_anti").drop("_gx", "_gy")


def committed(old: DataFrame, new: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """The snapshot to keep: new units but for the failed ones, which keep what they had."""
    return new.join(failed, key, "left_anti").unionByName(old.join(failed, key, "left_semi"))


def sync(shown: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """insert, replace, remove or keep for each id, by a hash of all columns."""
    digest = lambda df: F.xxhash64(*[c for c in sorted(df.columns) if c != key])
    a, b = shown.select(key, digest(shown).alias("old")), wanted.select(key, digest(wanted).alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "replace").otherwise("keep")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
