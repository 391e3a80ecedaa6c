"""Files written by tasks: all in place after a commit, nothing after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from quadrille.sources import file_sink


def found(path):
    return {os.path.relpath(os.path.join(d, n), path): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(path) for n in names}


def tiles(spark, rows):
    return file_sink.tile_files(spark.createDataFrame(rows, "layer int, level int, tx int, ty int, state string, png binary").repartition(3))


def test_tiles_as_files(spark, tmp_path):
    path = str(tmp_path / "out")
    file_sink.write_files(tiles(spark, [(0, 0, 0, 0, "saved", b"a"), (0, 0, -1, 2, "empty", None), (-1, 3, 0, 1, "saved", b"b")]), path)
    assert found(path) == {"layer0_files/0/0_0.png": b"a", "layer0_files/0/-1_2.empty": b"", "layer-1_files/3/0_1.png": b"b"}
    # a second run replaces what it names: a tile gets empty, an empty one is drawn, others stay
    file_sink.write_files(tiles(spark, [(0, 0, 0, 0, "empty", None), (0, 0, -1, 2, "saved", b"c")]), "file://" + path)
    assert found(path) == {"layer0_files/0/0_0.empty": b"", "layer0_files/0/-1_2.png": b"c", "layer-1_files/3/0_1.png": b"b"}


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    file_sink.write_files(tiles(spark, [(0, 0, 0, 0, "saved", b"a")]), path)
    bad = tiles(spark, [(0, 0, k, 0, "saved", b"new") for k in range(20)]).withColumn("content", F.when(F.col("path").contains("/13_"), F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    for rows in (bad, spark.createDataFrame([("ok", b"1"), ("../x", b"2")], "path string, content binary"), spark.createDataFrame([("/x", b"")], "path string, content binary")):
        with pytest.raises(Exception, match="broken|no relative path"):
            file_sink.write_files(rows, path)
        assert found(path) == {"layer0_files/0/0_0.png": b"a"} and os.listdir(path) == ["layer0_files"]
    with pytest.raises(ValueError):
        file_sink.local_path("s3://b/x")
