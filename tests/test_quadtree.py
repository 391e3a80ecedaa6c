"""Joins over the quadtree against all pairs, with hot spots, giants and odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry
from quadrille.operators import quadtree as Q


def frame(spark, rects):
    return spark.createDataFrame(rects, "id long, x long, y long, w long, h long, layer long")


def world(seed, n):
    """A third in one place, some long and thin, one over all, negative places, repeated rows' boxes."""
    rng = random.Random(seed)
    out = [(i, rng.randrange(-9, 9), rng.randrange(-9, 9), rng.randrange(1, 4), rng.randrange(1, 4), i % 2) for i in range(n // 3)]
    out += [(i, rng.randrange(-3000, 3000), rng.randrange(-3000, 3000), rng.randrange(0, 30), rng.randrange(0, 30), i % 2) for i in range(n // 3, n - 20)]
    out += [(i, -3000, rng.randrange(-3000, 3000), 6000, 1, i % 2) for i in range(n - 20, n - 10)]
    out += [(i, -2048, -1024, 2048, 1024, i % 2) for i in range(n - 10, n - 1)]
    return [*out, (n - 1, -4000, -4000, 8000, 8000, 0)]


def near(a, b, mode):
    x, y = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (1, 2))
    return a[5] == b[5] and {"closed": x >= 0 and y >= 0, "no_corner": x >= 0 and y >= 0 and (x > 0 or y > 0), "no_edge": (x > 0 and y > 0) or (x == 0 and y == 0), "open": x > 0 and y > 0}[mode]


@pytest.fixture
def deep(monkeypatch):
    """Small cells, so that few rows make a deep tree."""
    monkeypatch.setattr(Q, "NODE", 8)
    monkeypatch.setattr(Q, "ROWS", 2)


@pytest.mark.parametrize("mode", geometry.RELATIONS)
def test_pairs_equal_all_pairs(spark, deep, mode):
    rects = world(3, 400)
    df = frame(spark, rects)
    assert len({level for level, *_ in Q.tree(df).split}) >= 3
    got = sorted((r.a.id, r.b.id) for r in Q.rect_pairs(df, df, mode, ("layer",)).collect())
    assert got == sorted((a[0], b[0]) for a in rects for b in rects if near(a, b, mode))


def test_sample_does_not_decide_pairs(spark, deep, monkeypatch):
    rects = world(4, 300)
    df = frame(spark, rects)
    monkeypatch.setattr(Q, "SAMPLE", 20)
    assert len(Q.tree(df).split) < 60
    got = sorted((r.a.id, r.b.id) for r in Q.rect_pairs(df, df, "closed", ("layer",)).collect())
    assert got == sorted((a[0], b[0]) for a in rects for b in rects if near(a, b, "closed"))


def test_points(spark, deep):
    rects, rng = world(5, 300), random.Random(6)
    points = [(i, rng.randrange(-40, 40), rng.randrange(-3000, 3000)) for i in range(300)] + [(300, 0, 0), (301, 0, 0)]
    pairs = Q.point_pairs(spark.createDataFrame(points, "id long, x long, y long"), frame(spark, rects))
    inside = lambda p, r: r[1] <= p[1] < r[1] + r[3] and r[2] <= p[2] < r[2] + r[4]
    assert sorted((r.a.id, r.b.id) for r in pairs.collect()) == sorted((p[0], r[0]) for p in points for r in rects if inside(p, r))


def test_semi_join(spark, deep):
    rects = world(7, 300)
    df = frame(spark, rects)
    got = sorted(r.id for r in Q.related_keys(df, df, "id", "open", ("layer",), "b_id > a_id").collect())
    assert got == [a[0] for a in rects if any(b[0] > a[0] and near(a, b, "open") for b in rects)]


def test_odd_rows(spark):
    rects = [(1, None, 0, 1, 1, 0), (2, 0, 0, None, 1, 0), (3, 0, 0, 1, 1, None), (4, 0, 0, 2, 2, 0), (4, 0, 0, 2, 2, 0), (5, 1, 1, 0, 0, 0)]
    df = frame(spark, rects)
    assert sorted((r.a.id, r.b.id) for r in Q.rect_pairs(df, df, "closed", ("layer",)).collect()) == [(4, 4)] * 4 + [(4, 5)] * 2 + [(5, 4)] * 2 + [(5, 5)]
    none = df.limit(0)
    assert Q.rect_pairs(none, none).collect() == Q.rect_pairs(none, df).collect() == Q.related_keys(df, none, "id").collect() == []


def test_one_over_the_map_has_few_rows(spark):
    """10^5 small ones in the place of one bucket and as many elsewhere: the giant is not dealt to their cells."""
    n = 100_000
    i = F.col("id")
    small = spark.range(n).select("id", (i % 16).alias("x"), F.expr("id div 16 % 16").alias("y"), F.lit(0).alias("w"), F.lit(0).alias("h"))
    wide = spark.range(n, 2 * n).select("id", (i * 7919 % 65536).alias("x"), (i * 104729 % 65536).alias("y"), F.lit(3).alias("w"), F.lit(2).alias("h"))
    giant = spark.createDataFrame([(-1, -5, -5, 70000, 70000)], "id long, x long, y long, w int, h int")
    rects = small.unionByName(wide).unionByName(giant)
    t = Q.tree(rects)
    cells = Q.dealt(rects, "a", t).groupBy((F.col("a_id") >= 0).alias("small")).agg(F.count("*").alias("n"))
    rows = {r.small: r.n for r in cells.collect()}
    assert rows[False] < 4000 and rows[True] < 3 * 2 * n
    # every small one lies in the giant: found without listing pairs
    assert Q.related_keys(rects.filter("id >= 0"), rects, "id", "closed", where="b_id = -1").count() == 2 * n


def test_tree_is_bounded():
    rng = np.random.default_rng(1)
    boxes = np.concatenate([rng.integers(0, 1 << 40, (2 * Q.SAMPLE, 2)), np.ones((2 * Q.SAMPLE, 2), np.int64)], axis=1)
    boxes[: Q.SAMPLE, :2] = rng.integers(0, 1 << 10, (Q.SAMPLE, 2))
    assert len(Q.grown(boxes, 10**10, 41).split) < 1 << 18
