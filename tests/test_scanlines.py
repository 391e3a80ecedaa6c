"""Runs of squares in polygons against testing the middle of every square."""

import random

from quadrille.operators import scanlines


def inside(points, x, y):
    n = 0
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        left = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        n += (y1 <= y < y2 and left > 0) - (y2 <= y < y1 and left < 0)
    return n != 0


def test_column_runs(spark):
    """Any rings: self-crossing, with repeated points, edges through middles, to and fro, of two points."""
    rng = random.Random(2)
    rings = [[(rng.randrange(-9, 10), rng.randrange(-9, 10)) for _ in range(rng.choice([2, 3, 4, 5, 9]))] for _ in range(150)]
    rings += [[(rng.randrange(-12, 12) / 2, rng.randrange(-12, 12) / 4) for _ in range(5)] for _ in range(60)]
    rings += [[(0, 0), (4, 0), (4, 4), (0, 4)] * 2, [(0, 0), (9, 9), (0, 0)], [(0, 0), (5, 5), (5, 0)], [(0, 5), (5, 0), (5, 5)], [(0, 0), (100_000, 1), (0, 2)]]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)], "id int, ring array<struct<x:double,y:double>>")
    got = {}
    for r in scanlines.column_runs(df, ["id"]).collect():
        assert r.length > 0
        got.setdefault(r.id, set()).update((r.x, y) for y in range(r.start, r.start + r.length))
    for i, ring in enumerate(rings[:-1]):
        want = {(x, y) for x in range(-11, 12) for y in range(-11, 12) if inside(ring, x + 0.5, y + 0.5)}
        assert got.get(i, set()) == want, ring
    assert len(got[len(rings) - 1]) == sum(inside(rings[-1], x + 0.5, y + 0.5) for x in range(100_000) for y in (0, 1))
