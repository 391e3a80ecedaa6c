"""Polygons around polylines."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A mitred corner reaches at most so many half widths from its point; sharper ones are cut off square.
MITRE_LIMIT = 2.0


def around(points: list[tuple[float, float]], width: float) -> list[tuple[int, int]]:
    """Outline of a polyline of a width: mitred corners, flat ends, rounded to whole squares.

    An odd width moves the line by half a square first. Repeated points count once; fewer than two have no outline.
    """
    shift = 0.5 if width % 2 == 1 else 0.0
    line = [(x + shift, y + shift) for i, (x, y) in enumerate(points) if i == 0 or (x, y) != points[i - 1]]
    if len(line) < 2 or width <= 0:
        return []
    d = width / 2
    normals = []
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        length = math.hypot(bx - ax, by - ay)
        normals.append(((by - ay) / length, (ax - bx) / length))

    def side(path: list, across: list) -> list:
        out = [(path[0][0] + across[0][0] * d, path[0][1] + across[0][1] * d)]
        for (x, y), (ax, ay), (bx, by) in zip(path[1:-1], across, across[1:], strict=False):
            cosine = ax * bx + ay * by
            if 1 + cosine >= 2 / MITRE_LIMIT**2:
                out.append((x + (ax + bx) * d / (1 + cosine), y + (ay + by) * d / (1 + cosine)))
            else:
                out += [(x + ax * d, y + ay * d), (x + bx * d, y + by * d)]
        return [*out, (path[-1][0] + across[-1][0] * d, path[-1][1] + across[-1][1] * d)]

    left = side(line, normals)
    right = side(line[::-1], [(-x, -y) for x, y in normals[::-1]])
    return [(math.floor(x + 0.5), math.floor(y + 0.5)) for x, y in left + right]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def buffered(points: pd.Series, width: pd.Series) -> pd.Series:
    """Outline of each polyline (array of points x, y) of its width."""
    return pd.Series([None if p is None or w is None or w != w else [{"x": float(x), "y": float(y)} for x, y in around([(q["x"], q["y"]) for q in p], float(w))] for p, w in zip(points, width, strict=True)], dtype=object)
