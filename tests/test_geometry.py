"""Fixed cases and brute force for geometry, joins, windows and borders."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import coords, geometry
from quadrille.functions import values as V
from quadrille.operators import borders, joins, windows

FIVE = [(0, 0, 0, 2, 2), (1, 2, 0, 2, 2), (2, 2, 2, 2, 2), (3, 1, 1, 2, 2), (4, 5, 5, 1, 1)]
EXPECTED = {"closed": [{1, 2, 3}, {0, 2, 3}, {0, 1, 3}, {0, 1, 2}, set()], "no_corner": [{1, 3}, {0, 2, 3}, {1, 3}, {0, 1, 2}, set()], "no_edge": [{2, 3}, {3}, {0, 3}, {0, 1, 2}, set()], "open": [{3}, {3}, {3}, {0, 1, 2}, set()]}


def frame(spark, rects):
    return spark.createDataFrame(rects, "id long, x long, y long, w long, h long")


@pytest.mark.parametrize("mode", geometry.RELATIONS)
def test_five_rects(spark, mode):
    got = [set() for _ in FIVE]
    for r in joins.neighbours(frame(spark, FIVE), mode, bucket=2).collect():
        got[r.id].add(r.other)
    assert got == EXPECTED[mode]


def test_random_rects(spark):
    rng = random.Random(11)
    rects = [(i, rng.randrange(-40, 40), rng.randrange(-40, 40), rng.randrange(1, 13), rng.randrange(1, 13)) for i in range(300)]

    def near(a, b, mode):
        x = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        y = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
        return {"closed": x >= 0 and y >= 0, "no_corner": x >= 0 and y >= 0 and (x > 0 or y > 0), "no_edge": (x > 0 and y > 0) or (x == 0 and y == 0), "open": x > 0 and y > 0}[mode]

    for mode, bucket in zip(geometry.RELATIONS, (5, 8, 16, 100), strict=True):
        got = sorted(tuple(r) for r in joins.neighbours(frame(spark, rects), mode, bucket).collect())
        assert got == sorted((a[0], b[0]) for a in rects for b in rects if a[0] != b[0] and near(a, b, mode))


def _shuffled_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_neighbours_are_shuffled_once(spark):
    """What is shuffled grows with the rectangles: a few rows for each, not one for each bucket, side and way to meet."""
    rng = random.Random(3)
    rects = [(i, rng.randrange(60), rng.randrange(60), rng.randrange(1, 13), rng.randrange(1, 10)) for i in range(3000)]
    df = frame(spark, rects).repartition(1).localCheckpoint()
    before = _shuffled_rows(spark)
    joins.neighbours(df).write.format("noop").mode("overwrite").save()
    assert 0 < _shuffled_rows(spark) - before < 5 * len(rects)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_crowded_buckets_are_cut(spark, monkeypatch, kind):
    """Slices of a bucket, blocks of several buckets and steps of few pairs list each pair once; odd rows too."""
    for name, value in (("SLICE", 16), ("TOGETHER", 24), ("CELLS", 64), ("TRIED", 4)):
        monkeypatch.setattr(joins, name, value)
    rng = random.Random(12)
    rects = [(str(i % 190) if kind == "string" else i % 190, rng.choice([0, rng.randrange(-30, 30)]), rng.choice([1, rng.randrange(-30, 30)]), rng.randrange(0, 9), rng.randrange(0, 9), rng.choice([0, 1, None])) for i in range(200)]
    rects += [(rects[0][0], 0, 1, -3, 4, 0), (rects[1][0], 0, 1, 4, -1, 0), (None, 0, 1, 4, 4, 0), (rects[2][0], None, 1, 4, 4, 0), (rects[3][0], 1 << 40, 1, 4, 4, 0), (rects[4][0], 2 + (1 << 40), 1, 4, 4, 0)]
    df = spark.createDataFrame(rects, f"id {kind}, x long, y long, w long, h long, layer int")

    def near(a, b, mode):
        x, y = (min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k]) for k in (1, 2))
        return {"closed": x >= 0 and y >= 0, "no_corner": x >= 0 and y >= 0 and (x > 0 or y > 0), "no_edge": (x > 0 and y > 0) or (x == 0 and y == 0), "open": x > 0 and y > 0}[mode]

    whole = [r for r in rects if None not in r[:5]]
    for mode, on in zip(geometry.RELATIONS, ((), ("layer",), ("layer",), ()), strict=True):
        got = sorted(tuple(r) for r in joins.neighbours(df, mode, 16, on).collect())
        assert got == sorted((a[0], b[0]) for a in whole for b in whole if a[0] != b[0] and near(a, b, mode) and (not on or a[5] == b[5] is not None))


def test_window_flag(spark):
    from quadrille.operators.marks import boxed, in_window

    items = boxed(frame(spark, [(1, 10, 10, 5, 5), (2, 20, 20, 5, 5)]).withColumn("layer", F.lit(0)))
    assert [r.id for r in items.filter(in_window((15, 15, 25, 25), closed=False)).collect()] == [2]
    assert {r.id for r in items.filter(in_window((15, 15, 25, 25))).collect()} == {1, 2}


def test_clip_stays_on_the_segment(spark):
    df = spark.range(1).select(geometry.clip_segment(F.lit(93), F.lit(66), F.lit(5), F.lit(21), F.lit(40), F.lit(8), F.lit(44), F.lit(57)).alias("c"))
    c = df.first().c
    for x, y in ((c.xa, c.ya), (c.xb, c.yb)):
        assert 40 - 1e-9 <= x <= 44 + 1e-9 and 8 - 1e-9 <= y <= 57 + 1e-9
        assert abs((y - 66) * (5 - 93) - (x - 93) * (21 - 66)) < 1e-6


def test_polygons_hold_what_rects_hold(spark):
    rng = random.Random(5)
    rects = [(i, rng.randrange(40), rng.randrange(40), rng.randrange(1, 11), rng.randrange(1, 11)) for i in range(40)]
    squares = frame(spark, rects).select(F.lit(0).alias("g"), F.explode(geometry.squares_of("x", "y", "w", "h")).alias("p")).select("g", "p.x", "p.y").distinct()
    inside = {(r.x, r.y) for r in squares.collect()}
    rings = [[(p.x, p.y) for p in r.points] for r in borders.polygons(squares, ["g"]).collect()]
    for x in range(-1, 52):
        for y in range(-1, 52):
            hits = sum(1 for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[0] != b[0] and min(a[0], b[0]) <= x < max(a[0], b[0]) and y < a[1])
            assert (hits % 2 == 1) == ((x, y) in inside)
    for ring in rings:  # corners only
        for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True):
            assert (a[0] == b[0]) != (b[0] == c[0])


@pytest.mark.parametrize("rects", [[(0, 0, 10, 10), (10, 0, 8, 10), (18, 0, 6, 10), (40, 5, 8, 8)], [(0, 0, 5, 5), (3, 3, 5, 5), (3, 0, 1, 9), (20, 20, 2, 2)]])
def test_covers_are_disjoint(spark, rects):
    df = spark.createDataFrame([(0, *r) for r in rects], "g int, x long, y long, w long, h long")
    want = sorted({(x, y) for a, b, w, h in rects for x in range(a, a + w) for y in range(b, b + h)})
    squares = df.select("g", F.explode(geometry.squares_of("x", "y", "w", "h")).alias("p")).select("g", "p.x", "p.y").distinct()
    for cover in (borders.disjoint_cover(df, ["g"]), windows.rect_cover(squares, ["g"])):
        got = [(x, y) for r in cover.collect() for x in range(r.x, r.x + r.w) for y in range(r.y, r.y + r.h)]
        assert sorted(got) == want


def test_tiles_reach_every_contributor(spark):
    """The octagon's tiles hold each tile whose own margin holds one of the rectangle's squares."""
    margin, per = coords.affected_margin(coords.render_margin(False)), (4, 8)
    rects = [(i, i % 7 - 3, i * 5 % 11 - 5, 1 + i % 4, 1 + i % 3) for i in range(30)]
    got = {}
    for r in geometry.rect_tiles(frame(spark, rects), margin=margin, per_tile=per).select("id", "tx", "ty").collect():
        got.setdefault(r.id, set()).add((r.tx, r.ty))
    for i, x, y, w, h in rects:
        for sx in range(x, x + w):
            for sy in range(y, y + h):
                gx, gy = sx - sy, sx + sy
                for px in range(gx + margin[0], gx + margin[2]):
                    for py in range(gy + margin[1], gy + margin[3]):
                        assert (px // per[0], py // per[1]) in got[i]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    nodes = sorted({*range(200), *range(300, 361)})
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in joins.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 9)], "node long, needs long")
    got = sorted(map(tuple, joins.closure(spark.createDataFrame([(1,), (4,), (5,)], "root long"), edges).collect()))
    assert got == [(1, 1), (1, 2), (1, 3), (4, 4), (5, 5), (5, 9)]


def test_morton_and_options(spark):
    assert spark.range(1).select(coords.morton(F.lit(5), F.lit(3))).first()[0] == 27
    text = spark.createDataFrame([("a:1&&plain&&b:x:y",)], "t string").select(V.unpacked("t").alias("m")).first().m
    assert text == {"a": "1", "en": "plain", "b": "x:y"}
    at = spark.createDataFrame([("abs(3,44)",), ("top",)], "t string").select(V.absolute_anchor("t").alias("p")).collect()
    assert (at[0].p.x, at[0].p.y, at[1].p) == (3, 44, None)


def test_buffer_of_a_line(spark):
    from quadrille.functions.buffers import around, buffered

    assert around([(0, 0), (10, 0)], 4) == [(0, -2), (10, -2), (10, 2), (0, 2)]
    assert around([(0, 0), (10, 0), (10, 10)], 4) == [(0, -2), (12, -2), (12, 10), (8, 10), (8, 2), (0, 2)]
    assert around([(0, 0)], 4) == [] and around([(0, 0), (0, 0)], 2) == []
    df = spark.createDataFrame([([(0.0, 0.0), (10.0, 0.0)], 4), (None, 2), ([(0.0, 0.0), (0.0, 5.0)], None)], "p array<struct<x:double,y:double>>, w int")
    got = [r.b for r in df.select(buffered("p", "w").alias("b")).collect()]
    assert len(got[0]) == 4 and got[1] is None and got[2] is None


def test_closure_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(joins, "reliable", lambda df: written.append(1) or df.localCheckpoint())
    edges = spark.range(60).selectExpr("id AS node", "id + 1 AS needs")
    got = joins.closure(spark.createDataFrame([(0,), (50,)], "root long"), edges)
    assert got.filter("root = 0").count() == 61 and got.filter("root = 50").count() == 11
    assert len(written) < 20
