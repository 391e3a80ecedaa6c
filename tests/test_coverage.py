"""Overlap, components, hidden edges and point joins against brute force, with repeated ids, empty rectangles and piles."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import coverage, joins

KIND = "id long, layer int, x long, y long, w long, h long"


def some(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rects = [(i % 190, rng.randrange(2), rng.randrange(60), rng.randrange(60), rng.randrange(0, 9), rng.randrange(1, 8)) for i in range(200)]
    return [*rects, (500, None, 1, 1, 3, 3), (501, 0, 2, None, 3, 3), (None, 0, 3, 3, 9, 9)]


def pairs(rects: list[tuple]):
    full = [r for r in rects if None not in r]
    return ((a, b, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])) for a in full for b in full if a[1] == b[1] and a[0] != b[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_against_pairs(spark, seed):
    rects = some(seed)
    df, want, hidden = spark.createDataFrame(rects, KIND), {}, {}
    root = {r[0]: r[0] for r in rects if r[0] is not None}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b, x, y in pairs(rects):
        if x > 0 and y > 0:
            low, high = sorted((find(a[0]), find(b[0])))
            root[high] = low
            if a[0] < b[0]:
                want[a[1]] = want.get(a[1], 0) + x * y
        if b[2] <= a[2] + a[4] <= b[2] + b[4] and y > 0:
            hidden.setdefault(a[0], set()).update(range(max(a[3], b[3]), min(a[3] + a[5], b[3] + b[5])))
    assert {r.layer: r.overlap for r in coverage.total_overlap(df, ["layer"]).collect()} == want
    assert {r.id: r.hidden for r in coverage.hidden_edges(df, ["layer"]).collect()} == {i: len(ys) for i, ys in hidden.items()}
    got = coverage.overlap_components(df, ["layer"]).collect()
    assert {r.id: r.component for r in got} == {n: find(n) for n in root} and len(got) == len(root)


def test_piles_make_no_pairs(spark):
    """100000 rectangles on one place have 5e9 pairs."""
    n = 100_000
    df = spark.range(n).select("id", F.lit(0).alias("layer"), *(F.lit(v).cast("bigint").alias(c) for c, v in zip("xywh", (5, 6, 2, 3), strict=True)))
    assert [tuple(r) for r in coverage.total_overlap(df, ["layer"]).collect()] == [(0, n * (n - 1) // 2 * 6)]
    assert [tuple(r) for r in coverage.hidden_edges(df, ["layer"]).agg(F.count("*"), F.sum("hidden")).collect()] == [(n, 3 * n)]
    assert [tuple(r) for r in coverage.overlap_components(df, ["layer"]).groupBy("component").count().collect()] == [(0, n)]


def test_a_small_side_is_not_broadcast(spark):
    """Few tasks read a small file; its pairs must not be made by them alone."""
    df = spark.createDataFrame([(1, 0, 0, 2, 2), (2, 1, 1, 2, 2)], "id long, x long, y long, w long, h long")
    for out in (joins.neighbours(df), joins.point_join(df.select("x", "y"), df)):
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert joins.fitting_bucket(df) == 1 and joins.fitting_bucket(df.withColumn("w", F.lit(64))) == 8


def test_first_zone_of_equal_order(spark):
    zones = spark.createDataFrame([(1, "a", 0, 0, 4, 4), (1, "b", 50, 50, 4, 4), (0, "c", 3, 3, 1, 1), (1, "a", 1, 1, 4, 4)], "id long, type string, x long, y long, w long, h long")
    points = spark.createDataFrame([(1, 1), (3, 3), (51, 51), (20, 20)], "x long, y long")
    got = {(r.p.x, r.p.y, r.r.id, r.r.type) for r in joins.first_zone(points, zones, "id").collect()}
    assert got == {(1, 1, 1, "a"), (3, 3, 0, "c"), (51, 51, 1, "b")}


def test_tree_search_is_shuffled(spark):
    """Windows of a small file must not stay, with all that they find, in the tasks that read it."""
    from quadrille.operators import packed_tree as T

    boxes = spark.range(300).select("id", F.col("id").alias("x1"), F.lit(0).alias("y1"), (F.col("id") + 1).alias("x2"), F.lit(1).alias("y2"))
    found = T.search(T.load(boxes), boxes.filter("id = 50").withColumnRenamed("id", "q"))
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 3
    assert sorted(r.id for r in found.collect()) == [49, 50, 51]
