"""Joins of rectangles over a quadtree of local density.

A bounded sample of both sides says where rectangles are dense; the tree's split cells go out as a small table, and
rectangles go down it where they are, a batch at a time, without a shuffle. A rectangle stays at a cell that it covers
whole, so that one over the whole map has a few rows; others meet it there by the ancestors of their own cells. The
sample decides only how cells are cut: pairs are the same with any tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_rect, related

#: Rows of the sample; bounds the driver's memory and, with NODE, the tree's size (below 2^18 cells).
SAMPLE = 1 << 14
#: Sampled rectangles that a cell may hold before it is split in sixteen.
NODE = 64
#: Rectangles that a cell at the bottom should hold.
ROWS = 32
#: Levels from the roots down to the least split cell.
DEPTH = 27


@dataclass(frozen=True)
class Tree:
    """Cells of level k have sides of 2^k. Roots are of level `top`; the cells in `split` are cut `down` levels at once."""

    top: int
    split: list[tuple[int, int, int, int]]

    @cached_property
    def table(self) -> tuple:
        """Split cells in order of one number each, counted from the least root: (down, number, least root)."""
        level, cx, cy, down = np.array(self.split, np.int64).reshape(-1, 4).T
        low = [(c >> (self.top - level)).min(initial=1 << 40) for c in (cx, cy)]
        number = self._number(level, cx, cy, *low)[0]
        order = np.argsort(number)
        return down[order], number[order], *low

    def _number(self, level: np.ndarray, cx: np.ndarray, cy: np.ndarray, low_x: int, low_y: int) -> tuple:
        x, y = cx - (low_x << (self.top - level)), cy - (low_y << (self.top - level))
        return (level << 58) ^ (x << 29) ^ y, (x >= 0) & (y >= 0)

    def find(self, level: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and whether the cells are in it."""
        _, known, *low = self.table
        if not len(known):
            return np.zeros(len(level), np.int64), np.zeros(len(level), bool)
        number, inside = self._number(level, cx, cy, *low)
        k = np.minimum(np.searchsorted(known, number), len(known) - 1)
        return k, inside & (known[k] == number)


def grown(boxes: np.ndarray, total: int, top: int) -> Tree:
    """The tree of sampled boxes (x, y, w, h), which stand for `total` in all."""
    split, each = [], total / max(1, len(boxes))
    middle, extent = boxes[:, :2] + boxes[:, 2:] // 2, boxes[:, 2:].max(axis=1, initial=0) + 1
    rows = np.arange(len(boxes))
    todo = [(top, r) for r in _parts(middle, rows, top)]
    while todo:
        level, rows = todo.pop()
        # smaller cells would each hold the same rectangles; numbers of cells take 58 bits
        least = max(math.ceil(math.log2(np.median(extent[rows]))), top - DEPTH)
        crowded = len(rows) * each / ROWS
        down = min(level - least, math.ceil(math.log(crowded, 4)) if crowded > 1 else 0)
        if down <= 0:
            continue
        dense = len(rows) > NODE and down > 2
        cx, cy = (int(v) for v in middle[rows[0]] >> level)
        split.append((level, cx, cy, 2 if dense else down))
        if dense:
            todo += [(level - 2, r) for r in _parts(middle, rows, level - 2)]
    return Tree(top, split)


def _parts(middle: np.ndarray, rows: np.ndarray, level: int) -> list[np.ndarray]:
    """Rows by the cells of a level that hold their middles."""
    if not len(rows):
        return []
    _, of = np.unique(middle[rows] >> level, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    return np.split(rows[order], np.flatnonzero(np.diff(of.ravel()[order])) + 1)


def tree(*sides: DataFrame) -> Tree:
    """The tree for rectangles (x, y, w, h, whole numbers) of all sides: one pass for their extent, one for the sample."""
    boxes = sides[0].select(*(F.col(c).cast("bigint").alias(c) for c in "xywh"))
    for side in sides[1:]:
        boxes = boxes.union(side.select(*(F.col(c).cast("bigint") for c in "xywh")))
    boxes = boxes.dropna()
    e = boxes.agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("fx"), F.max(F.col("y") + F.col("h")).alias("fy")).first()
    if not e["n"]:
        return Tree(0, [])
    top = (max(e["fx"] - e["x"], e["fy"] - e["y"]) + 1).bit_length()
    sample = boxes if e["n"] <= SAMPLE else boxes.sample(SAMPLE / e["n"], seed=1).limit(2 * SAMPLE)
    rows = np.array([tuple(r) for r in sample.collect()], np.int64).reshape(-1, 4)
    return grown(rows, e["n"], top)


def cells(t: Tree, x: np.ndarray, y: np.ndarray, fx: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, level, cx, cy, inner) of the cells of closed rectangles from (x, y) to (fx, fy), in order of rows.

    All rectangles go down a step at once; those at a cell that isn't split, or that they cover, stay.
    """
    row, at = np.arange(len(x)), np.full(len(x), t.top)
    box = x >> at, fx >> at, y >> at, fy >> at
    done = []
    while len(row):
        row, at, cx, cy = _spread(row, at, *box)
        k, cut = t.find(at, cx, cy)
        own = [v[row] for v in (x, fx, y, fy)]
        covered = (own[0] <= cx << at) & (own[1] >= (cx + 1) << at) & (own[2] <= cy << at) & (own[3] >= (cy + 1) << at)
        go = cut & ~covered
        done.append((row[~go], at[~go], cx[~go], cy[~go], cut[~go]))
        d = t.table[0][k[go]]
        row, at, cx, cy = row[go], at[go] - d, cx[go], cy[go]
        low, high = (np.maximum, np.minimum)
        box = low(x[row] >> at, cx << d), high(fx[row] >> at, ((cx + 1) << d) - 1), low(y[row] >> at, cy << d), high(fy[row] >> at, ((cy + 1) << d) - 1)
    if not done:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
    out = [np.concatenate(c) for c in zip(*done, strict=True)]
    order = np.argsort(out[0], kind="stable")
    return tuple(c[order] for c in out)


def _spread(row: np.ndarray, at: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, level, cx, cy) of all cells of blocks of cells."""
    high = y1 - y0 + 1
    n = (x1 - x0 + 1) * high
    k = np.repeat(np.arange(len(row)), n)
    i = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    return row[k], at[k], x0[k] + i // high[k], y0[k] + i % high[k]


CELLS = "array<struct<level:int,cx:bigint,cy:bigint,own:boolean,inner:boolean,at:int,ax:bigint,ay:bigint>>"
KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())


def dealt(df: DataFrame, tag: str, t: Tree, held: Tree | None = None) -> DataFrame:
    """Columns with the tag in front, and a row for each cell (level, cx, cy) that a closed rectangle meets others in.

    Its own cells are disjoint and hold all of it: cells at the bottom that it touches, and cells above (`inner`) that it
    covers. It meets those that cover a cell of `held` there, if its own cell (at, ax, ay) lies below. A rectangle with a
    null among x, y, w and h has none. Only the four numbers go to Python.
    """
    plain = [u and (u.top, u.split) for u in (t, held)]  # broadcasts are pickled by reference to modules, which workers need not have
    shared, trees = df.sparkSession.sparkContext.broadcast(plain), []

    def run(x: pa.Array, y: pa.Array, fx: pa.Array, fy: pa.Array) -> pa.Array:
        if not trees:  # once for each task
            trees.extend(u and Tree(*u) for u in shared.value)
        tree_, above = trees
        sides = [np.asarray(c.fill_null(0)) for c in (x, y, fx, fy)]
        whole = np.flatnonzero(np.all([np.asarray(c.is_valid()) for c in (x, y, fx, fy)], axis=0))
        row, at, cx, cy, inner = cells(tree_, *(c[whole] for c in sides))
        found = [(row, at, cx, cy, np.ones(len(row), bool), inner, at, cx, cy)]
        for level in sorted({n[0] for n in above.split}) if above else ():
            low = np.flatnonzero(at < level)
            up = row[low], np.full(len(low), level), cx[low] >> (level - at[low]), cy[low] >> (level - at[low])
            meets = above.find(*up[1:])[1]
            found.append(tuple(c[meets] for c in (*up, np.zeros(len(low), bool), inner[low], at[low], cx[low], cy[low])))
        row, *out = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        ends = np.cumsum(np.bincount(whole[row], minlength=len(x)))
        items = pa.StructArray.from_arrays([pa.array(c[order], k) for c, k in zip(out, KINDS, strict=True)], ["level", "cx", "cy", "own", "inner", "at", "ax", "ay"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), items)

    box = [F.col(f"{tag}_{a}").cast("bigint") for a in "xy"] + [(F.col(f"{tag}_{a}") + F.col(f"{tag}_{b}")).cast("bigint") for a, b in ("xw", "yh")]
    flat = df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))
    return flat.select("*", F.inline(F.arrow_udf(run, CELLS)(*box)))


def _held(df: DataFrame, t: Tree) -> Tree:
    """The split cells that a rectangle covers, no more than the tree has. Only rectangles of such a size are looked at."""
    least = 1 << min((level for level, *_ in t.split), default=t.top)
    large = df.select(*"xywh").filter((F.col("w") >= least) & (F.col("h") >= least))
    return Tree(t.top, [(*r, 0) for r in dealt(large, "c", t).filter("inner").select("level", "cx", "cy").distinct().collect()])


def _sides(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides by cell, and the condition that a pair meets: same cell, one of them dealt to it, equal values of `on`."""
    t = tree(left, right)
    held = _held(left, t)
    a, b = dealt(left, "a", t, held if left is right else _held(right, t)).drop("inner"), dealt(right, "b", t, held).drop("inner")
    own = ["level", "cx", "cy", "own", "at", "ax", "ay"]
    a, b = a.withColumnsRenamed({c: f"a_{c}_" for c in own}), b.withColumnsRenamed({c: f"b_{c}_" for c in own})
    meets = (F.col("a_own_") | F.col("b_own_")) & (F.col("a_level_") == F.col("b_level_")) & (F.col("a_cx_") == F.col("b_cx_")) & (F.col("a_cy_") == F.col("b_cy_"))
    for k in on:
        meets = meets & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a, b, meets


def _once() -> Column:
    """That both rectangles' cells hold the corner where their overlap begins: true in one meeting of a pair."""
    holds = [F.expr(f"shiftright(CAST(greatest(a_{v}, b_{v}) AS BIGINT), {t}_at_) = {t}_a{v}_") for t in "ab" for v in "xy"]
    return holds[0] & holds[1] & holds[2] & holds[3]


def _boxes() -> list[dict]:
    return [{s: F.col(f"{t}_{s}") for s in "xywh"} for t in "ab"]


def _packed(df: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    return df.select(*(F.struct(*(F.col(f"{t}_{c}").alias(c) for c in side.columns)).alias(t) for t, side in (("a", left), ("b", right))))


def rect_pairs(left: DataFrame, right: DataFrame, mode: str = "closed", on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of related rectangles, each once; equal values of `on` too (J6). Rows with nulls there have no pair."""
    a, b, meets = _sides(left, right, on)
    return _packed(a.join(b, meets & related(*_boxes(), mode) & _once()), left, right)


def point_pairs(points: DataFrame, rects: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of points (x, y) and the half-open rectangles around them."""
    a, b, meets = _sides(points.withColumns({"w": F.lit(0), "h": F.lit(0)}), rects, on)
    return _packed(a.join(b, meets & in_rect("a_x", "a_y", "b_x", "b_y", "b_w", "b_h") & _once()), points, rects)


def related_keys(left: DataFrame, right: DataFrame, key: str, mode: str = "closed", on: tuple[str, ...] = (), where: str = "true") -> DataFrame:
    """Values of `key` of the left rectangles that are related to any on the right for which `where` (over a_ and b_ columns) holds.

    A semi-join: a search ends at the first that is found, and no pairs come out (J16).
    """
    a, b, meets = _sides(left, right, on)
    return a.join(b, meets & related(*_boxes(), mode) & F.expr(where), "left_semi").select(F.col(f"a_{key}").alias(key)).distinct()
