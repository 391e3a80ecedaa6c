"""Incremental work as a stream (I1-I4): signatures of arriving source files, and what they make stale.

A file stream with a checkpoint is what interrupted runs resume from: each batch of changed sources is folded into the
snapshot table once, and its tiles are written out as stale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import signatures, snapshot_diff

SOURCE = "ux bigint, uy bigint, mtime bigint, sig string"


def source_stream(spark: SparkSession, path: str) -> DataFrame:
    """Source records (ux, uy, mtime, sig) from Parquet files as they arrive."""
    return spark.readStream.schema(SOURCE).parquet(path)


def follow(stream: DataFrame, snapshot: str, checkpoint: str, on_changed: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Folds each batch into the snapshot at a path, and gives changed units to on_changed(units, batch number).

    Versions of the snapshot are folders named by batch; a batch that is run again after a crash reads the version
    before it and overwrites its own, so that every batch counts once.
    """
    key = ["ux", "uy"]

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = signatures(batch, key)
        empty = spark.createDataFrame([], "ux bigint, uy bigint, mtime bigint, sigs array<string>")
        old = spark.read.parquet(f"{snapshot}/{number - 1}") if number else empty
        touched = old.join(new.select(*key), key, "left_semi")
        diff = snapshot_diff(touched, new, key, F.lit(number).cast("bigint"))
        on_changed(diff.filter("state <> 'same'"), number)
        old.join(new.select(*key), key, "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{snapshot}/{number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_heat(stream: DataFrame, block: int = 8) -> DataFrame:
    """Population of blocks over a stream of points (layer, x, y), for update or complete output."""
    from ..operators.pyramid import heat_blocks

    return heat_blocks(stream, block)
