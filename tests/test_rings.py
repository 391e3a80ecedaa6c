"""Rings by pointer doubling against flood filling."""

import random

from quadrille.operators import borders


def flooded(squares):
    left, out = set(squares), {}
    while left:
        start = min(left, key=lambda p: (p[1], p[0]))
        part, todo = set(), [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in left:
                left.remove((x, y))
                part.add((x, y))
                todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
        out[start[1], start[0]] = part
    return out


def area(points):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(points, points[1:] + points[:1], strict=True)) // 2


def test_components_and_holes(spark):
    rng = random.Random(5)
    groups = {g: {(x, y) for x in range(-7, 9) for y in range(-5, 8) if rng.random() < share} for g, share in ((1, 0.4), (2, 0.6), (3, 0.85))}
    frame = {(x, y) for x in range(20) for y in range(20) if 2 < min(x, y, 19 - x, 19 - y) < 5 or min(x, y, 19 - x, 19 - y) == 0}
    groups[4] = frame | {(9, 9), (10, 10)}  # rings within holes, and squares that touch at a corner
    squares = spark.createDataFrame([(g, x, y) for g, s in groups.items() for x, y in s], "g int, x bigint, y bigint")
    rings = borders.polygons(squares, ["g"]).cache()
    for g, own in groups.items():
        rows = [r for r in rings.collect() if r.g == g]
        want = flooded(own)
        assert {(r.outer.y, r.outer.x) for r in rows} == set(want)
        for place, part in want.items():
            mine = [r for r in rows if (r.outer.y, r.outer.x) == place]
            assert sum(r.kind == "outer" for r in mine) == 1
            assert sum(area(r.points) for r in mine) == len(part)
            assert all((area(r.points) > 0) == (r.kind == "outer") == (r.ring == r.outer) for r in mine)
            for r in mine:  # corners alone, by turns along x and y
                steps = [(a.x == b.x, a.y == b.y) for a, b in zip(r.points, r.points[1:] + r.points[:1], strict=True)]
                assert all(one != two and True in one and False in one for one, two in zip(steps, steps[1:] + steps[:1], strict=True))
    paths = {r.outer.x: r.path for r in borders.outlines(rings.filter("g = 4"), ["g"]).collect()}
    assert paths[0] == "M0 0L20 0L20 20L0 20ZM1 1L1 19L19 19L19 1Z" or paths[0].startswith("M20 0L20 20L0 20L0 0Z")
    assert sum(p.count("M") for p in paths.values()) == 6 and len(paths) == 4


def test_holes_under_holes(spark):
    """A column of holes: each is told its outer ring by the one above."""
    squares = {(x, y) for x in range(3) for y in range(21)} - {(1, y) for y in range(1, 20, 2)}
    rings = borders.polygons(spark.createDataFrame([(1, x, y) for x, y in squares], "g int, x bigint, y bigint"), ["g"]).collect()
    assert len(rings) == 11 and {tuple(r.outer) for r in rings} == {(0, 0, 0)} and sum(area(r.points) for r in rings) == len(squares)


def test_one_long_ring(spark):
    """A snake whose ring has over a thousand edges, in one group; and no squares."""
    snake = {(x, y) for y in range(0, 20, 2) for x in range(40)} | {(39 if y % 4 == 1 else 0, y) for y in range(1, 19, 2)}
    corners = borders.ring_corners(spark.createDataFrame([(1, x, y) for x, y in snake], "g int, x bigint, y bigint"), ["g"]).orderBy("pos").collect()
    assert {r.kind for r in corners} == {"outer"} and len({tuple(r.ring) for r in corners}) == 1 and area(corners) == len(snake)
    assert borders.polygons(spark.createDataFrame([], "g int, x bigint, y bigint"), ["g"]).count() == 0
