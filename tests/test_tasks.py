"""Rows that are made into many more are dealt to as many tasks as they ask for, so that a task's memory has a bound."""

import pytest
from pyspark.sql import functions as F

from quadrille.plans import decoding, geometries, relations
from quadrille.storage import ROWS_EACH, tasks_for


def test_tasks_grow_with_rows(spark):
    assert [tasks_for(spark.range(n)) for n in (0, ROWS_EACH, 3 * ROWS_EACH + 1)] == [1, 2, 4]


def test_no_task_holds_many_cells(spark):
    cells = decoding._cells(spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).count()
    assert cells.agg(F.max("count")).first()[0] < 3 * ROWS_EACH // 64


@pytest.mark.parametrize("query", [relations.X1_border_labels, decoding.job_room_borders, geometries.G4_G19_polyline_squares])
def test_squares_are_dealt_to_tasks(spark, query):
    tasks = 1 + 20000 // ROWS_EACH
    plan = query(spark, "/root/testdata/sf0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert f"], {tasks}" in plan
