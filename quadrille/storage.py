"""The shared folder for checkpoints and written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a session in one machine (master local) gets a folder below /tmp/checkpoints; on a
    cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Rows for a task whose rows are made into many more.
ROWS_EACH = 4096


def tasks_for(df: DataFrame, each: int = ROWS_EACH) -> int:
    """How many tasks the rows of a table ask for, so that a task's memory doesn't grow with the table; counts it."""
    return 1 + df.count() // each


def reliable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in files of the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
