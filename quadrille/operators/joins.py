"""Spatial and interval joins as bucketed equi joins (J4-J8, J16), components (C1), closure."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import col, floor_div
from ..functions.geometry import in_rect, related
from ..storage import reliable


def _spans(low: Column, high: Column, size: int) -> Column:
    return F.sequence(floor_div(low, size), floor_div(high, size))


def _flat(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{tag}_{c}") for c in df.columns))


def _packed(columns: list[str], tag: str) -> Column:
    return F.struct(*(F.col(f"{tag}_{c}").alias(c) for c in columns)).alias(tag)


def spread(df: DataFrame) -> DataFrame:
    """Rectangles dealt to all tasks: a small file has few splits, and what is made of its rows is much larger."""
    return df.repartition("x", "y")


#: Rows in buckets that a rectangle should have at most, on average.
SPREAD = 16


def _bucketed(df: DataFrame, bucket: int, tag: str) -> DataFrame:
    """A row for each bucket that a closed rectangle touches; columns get the tag in front."""
    x, y, w, h = (F.col(f"{tag}_{c}") for c in ("x", "y", "w", "h"))
    return _flat(df, tag).withColumn("bx", F.explode(_spans(x, x + w, bucket))).withColumn("by", F.explode(_spans(y, y + h, bucket)))


def _sizes(*sides: DataFrame) -> tuple[float, float]:
    """Area, and width and height, of the average rectangle (w, h); one pass over sizes."""
    sizes = sides[0].select("w", "h")
    for side in sides[1:]:
        sizes = sizes.union(side.select("w", "h"))
    w, h = (F.greatest(F.col(c), F.lit(0)).cast("double") for c in "wh")
    area, edges = sizes.agg(F.avg(w * h), F.avg(w + h)).first()
    return area or 0, edges or 0


def _fitting(area: float, edges: float, rows: int) -> int:
    bucket = 1
    while area / bucket**2 + edges / bucket + 1 > rows:
        bucket *= 2
    return bucket


def fitting_bucket(*sides: DataFrame, rows: int = SPREAD) -> int:
    """The least power of two that gives rectangles (w, h) no more than `rows` rows on average."""
    return _fitting(*_sizes(*sides), rows)


#: How the bucket of a pair's overlap lies in each of them, as (left, right): at the corner, on the first column or the first
#: row (without the corner), anywhere or anywhere but at the corner. Each pair has exactly one of these.
_MEETINGS = (("corner", "any"), ("rest", "corner"), ("column", "row"), ("row", "column"))


def _placed(df: DataFrame, bucket: int, tag: str) -> DataFrame:
    """Rows of _bucketed for each of _MEETINGS (`meeting`) that a rectangle takes part in with that bucket."""
    first = [F.col(f"b{c}") == floor_div(f"{tag}_{c}", bucket) for c in "xy"]
    at = {"any": F.lit(True), "corner": first[0] & first[1], "rest": ~(first[0] & first[1]), "column": first[0] & ~first[1], "row": first[1] & ~first[0]}
    side = "ab".index(tag)
    parts = F.array_compact(F.array(*(F.when(at[m[side]], F.lit(k)) for k, m in enumerate(_MEETINGS))))
    return _bucketed(df, bucket, tag).withColumn("meeting", F.explode(parts))


def _keyed(df: DataFrame, tag: str, on: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"_{k}": F.col(f"{tag}_{k}") for k in on}) if on else df


def rect_join(left: DataFrame, right: DataFrame, mode: str = "closed", bucket: int | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of related rectangles (x, y, w, h); equal values of `on` too.

    Both sides are dealt to grid buckets (of a size that fits them, if none is given) and joined on them. A pair meets only
    in the bucket that holds the corner where its overlap begins, so that none comes twice and nothing has to be made
    distinct: that bucket is the first column of one and the first row of one, and the join is on that as well, so that
    rectangles that only share other buckets are not compared there. Rows of a small file can make very many pairs, so that
    neither side is broadcast: the pairs would be made by the few tasks that read the file.
    """
    bucket = bucket or fitting_bucket(left, right)
    a, b = (_keyed(_placed(spread(df), bucket, t), t, on) for df, t in ((left, "a"), (right, "b")))
    pairs = a.join(b.hint("merge"), ["bx", "by", "meeting", *(f"_{k}" for k in on)])
    boxes = [{s: F.col(f"{t}_{s}") for s in ("x", "y", "w", "h")} for t in ("a", "b")]
    return pairs.filter(related(*boxes, mode)).select(_packed(left.columns, "a"), _packed(right.columns, "b"))


#: Rows of a bucket that are compared as one block, rows of small buckets that are compared together, and pairs tried at once.
SLICE = 1 << 15
TOGETHER = 512
CELLS = 1 << 17
#: Rows in buckets that a rectangle has on average where pairs are listed: it is shuffled as often.
COPIES = 4
#: Pairs tried in a task, as a power of two, where the tasks of all cores would try more.
TRIED = 27


def _blocks(rects: DataFrame, bucket: int, on: tuple[str, ...]) -> tuple[DataFrame, list[str], int]:
    """Rows of rectangles by bucket and, where a bucket has more than SLICE, by each two of its slices; the key's names, and a number of tasks."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    whole = rects.dropna(subset=list(rects.columns)).filter((w >= 0) & (h >= 0))  # others are related to none
    flat = whole.select("id", "x", "y", (x + w).alias("right"), (y + h).alias("bottom"), *(F.col(k).alias(f"_{k}") for k in on))
    placed = flat.withColumn("bx", F.explode(_spans(x, F.col("right"), bucket))).withColumn("by", F.explode(_spans(y, F.col("bottom"), bucket)))
    keys = ["bx", "by", *(f"_{k}" for k in on)]
    counts = reliable(placed.groupBy(*keys).agg(F.count("*").alias("n")))
    slices = F.ceil(F.col("n") / SLICE)
    most, tried, blocks = counts.agg(F.max("n"), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(slices * (slices + 1) / 2)).first()
    tasks = max(1, int(min(blocks or 1, max(4 * rects.sparkSession.sparkContext.defaultParallelism, (tried or 0) / (1 << TRIED)))))
    if (most or 0) <= SLICE:
        return placed.withColumns({c: F.lit(0).cast("bigint") for c in ("own", "lower", "upper")}), [*keys, "lower", "upper"], tasks
    crowded = F.broadcast(counts.filter(F.col("n") > SLICE).select(*keys, slices.alias("slices")))  # a row for SLICE rows of rectangles at most
    dealt = placed.join(crowded, keys, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id", "x", "y", "right", "bottom"), F.col("slices"))).withColumn("far", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)))
    return dealt.withColumns({"lower": F.least("own", "far"), "upper": F.greatest("own", "far")}).drop("slices", "far"), [*keys, "lower", "upper"], tasks


def _related(left: tuple, right: tuple, mode: str) -> np.ndarray:
    """geometry.related for each two of (x, y, right, bottom)."""
    x, y = (np.minimum(left[k + 2][:, None], right[k + 2]) - np.maximum(left[k][:, None], right[k]) for k in (0, 1))
    if mode == "open":
        return (x > 0) & (y > 0)
    closed = (x >= 0) & (y >= 0)
    if mode == "no_corner":
        return closed & ((x > 0) | (y > 0))
    if mode == "no_edge":
        return closed & ((x > 0) == (y > 0))
    return closed


#: Places of classes 0 to 3 (begins on the bucket's columns, 1, and rows, 2) in a block, and for each place those that it can meet.
_CLASSES = np.array([3, 0, 2, 1])
_MET = ((1, 3), (0, 4), (0, 2), (1, 2))


def _ends(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole groups: as many as have TOGETHER rows, or a larger one."""
    start, ends = 0, np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)).tolist()
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or ends[k + 1] - start > TOGETHER:
            yield start, end
            start = end


def _finer(blocks: pa.Table, group: np.ndarray, bucket: int, fine: int, mode: str) -> Iterator[pa.RecordBatch]:
    """(id, others) of related rectangles of each block; group tells the block of each row.

    Blocks are cut down to the fine buckets in them: rectangles that begin in one have nearly the same neighbours, so that few
    pairs are tried in vain, and lists that are alike stand together, where a file's compression finds them.
    """
    at = {c: blocks[c].to_numpy() for c in ("x", "y", "right", "bottom", "bx", "by", "own", "lower", "upper")}
    ids = blocks["id"].combine_chunks()
    code = ids.to_numpy() if pa.types.is_integer(ids.type) else ids.dictionary_encode().indices.to_numpy()
    low = [(np.maximum(at[c], at[f"b{c}"] * bucket) // fine).astype(np.int64) for c in "xy"]
    wide, high = ((np.minimum(at[e], at[f"b{c}"] * bucket + bucket - 1) // fine).astype(np.int64) - lo + 1 for c, e, lo in zip("xy", ("right", "bottom"), low, strict=True))
    row = np.repeat(np.arange(len(code)), wide * high)
    step = np.arange(len(row)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
    bx, by = low[0][row] + step % wide[row], low[1][row] + step // wide[row]
    begins = (at["x"][row] >= bx * fine) + 2 * (at["y"][row] >= by * fine)
    order = np.lexsort((bx, by, group[row]))
    row, bx, by, begins = row[order], bx[order], by[order], begins[order]
    new = (group[row][1:] != group[row][:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])
    fines = np.append(0, np.cumsum(new))
    for a, b in _ends(fines):
        place = _CLASSES[begins[a:b]]
        own = np.argsort(place, kind="stable")
        yield from _pairs({c: at[c][row[a:b][own]] for c in ("x", "y", "right", "bottom", "own", "lower", "upper")}, ids.take(pa.array(row[a:b][own])), code[row[a:b][own]], fines[a:b][own], np.searchsorted(place[own], range(5)).tolist(), mode)


def _pairs(at: dict[str, np.ndarray], ids: pa.Array, code: np.ndarray, group: np.ndarray, places: list[int], mode: str) -> Iterator[pa.RecordBatch]:
    """(id, others) of related rectangles of the same group; equal ids have equal codes, rows of one class stand between two `places`.

    A pair is listed in the bucket where its overlap begins: one of the two begins on its columns and one on its rows.
    """
    edges = [at[c] - at[o].min() for c, o in (("x", "x"), ("y", "y"), ("right", "x"), ("bottom", "y"))]
    most = max(e.max() if e.dtype.kind == "i" else np.inf for e in edges)
    edges = [e.astype(np.int16 if most < 1 << 14 else np.int32 if most < 1 << 30 else e.dtype) for e in edges]
    several, equal = len(np.unique(group)) > 1, len(np.unique(code)) < len(code)
    apart = at["lower"] < at["upper"]
    for k, (first, last) in enumerate(_MET):
        met = slice(places[first], places[last])
        size = met.stop - met.start
        step = max(1, CELLS // max(1, size))
        for a in range(places[k], places[k + 1] if size else 0, step):
            own = slice(a, min(a + step, places[k + 1]))
            found = _related([e[own] for e in edges], [e[met] for e in edges], mode)
            if several:
                found &= group[own][:, None] == group[met]
            if apart.any():
                found &= (at["own"][own][:, None] != at["own"][met]) | ~apart[met]
            if equal:
                found &= code[own][:, None] != code[met]
            elif k == 1:
                found[np.arange(len(found)), np.arange(own.start, own.stop)] = False  # each rectangle itself
            n = np.count_nonzero(found, axis=1)
            others = np.flatnonzero(found) - np.repeat(np.arange(len(found)) * size - met.start, n)
            yield pa.RecordBatch.from_arrays([ids[own], pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), ids.take(pa.array(others)))], ["id", "others"])


def neighbours(rects: DataFrame, mode: str = "closed", bucket: int | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """(id, other) of all related pairs of different rectangles, both ways round (J6); equal values of `on` too.

    Rectangles are shuffled once, by buckets of a size that fits them, and a task compares those of a bucket in numpy. What is
    shuffled grows with the table and not with its pairs; a bucket of more than SLICE rows is cut, and each two of its slices
    are compared by a task of their own, so that neither memory nor a task grows with a crowded place (rows that are equal in
    all of these columns stay in one slice).
    """
    rects = rects.select("id", "x", "y", "w", "h", *on)
    sizes = _sizes(rects)
    bucket = bucket or _fitting(*sizes, COPIES)
    fine = min(bucket, _fitting(*sizes, SPREAD))
    fine = bucket if bucket % fine else fine
    blocks, keys, tasks = _blocks(rects, bucket, on)
    kind = dict(rects.dtypes)["id"]

    def grouped(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), np.int64)
        for k in keys:
            c = table[k].combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < 2 * TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            group = grouped(table)
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            for a, b in _ends(group[:whole]) if whole else ():
                yield from _finer(table.slice(a, b - a), group[a:b], bucket, fine, mode)
            held, rows = table.slice(whole).to_batches(), len(table) - whole
        if rows:
            table = pa.Table.from_batches(held)
            group = grouped(table)
            for a, b in _ends(group):
                yield from _finer(table.slice(a, b - a), group[a:b], bucket, fine, mode)

    lists = blocks.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"id {kind}, others array<{kind}>")
    return lists.select("id", F.explode("others").alias("other"))


def point_join(points: DataFrame, rects: DataFrame, bucket: int | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (p, r) of points and the half-open rectangles around them (J4, J5, G3); neither side is broadcast, as in rect_join."""
    bucket = bucket or fitting_bucket(rects, rows=SPREAD // 4)
    p = _keyed(_flat(points, "p"), "p", on).withColumns({"bx": floor_div("p_x", bucket), "by": floor_div("p_y", bucket)})
    pairs = p.join(_keyed(_bucketed(spread(rects), bucket, "r"), "r", on).hint("merge"), ["bx", "by", *(f"_{k}" for k in on)])
    inside = in_rect("p_x", "p_y", "r_x", "r_y", "r_w", "r_h")
    return pairs.filter(inside).select(_packed(points.columns, "p"), _packed(rects.columns, "r"))


def interval_join(left: DataFrame, right: DataFrame, bucket: int = 16, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of closed intervals [s, e] that meet (J7); kept in the bucket of the larger start."""
    a, b = (_keyed(_flat(df, t), t, on).withColumn("bucket", F.explode(_spans(F.col(f"{t}_s"), F.col(f"{t}_e"), bucket))) for df, t in ((left, "a"), (right, "b")))
    pairs = a.join(b, ["bucket", *(f"_{k}" for k in on)])
    meet = (F.col("a_s") <= F.col("b_e")) & (F.col("a_e") >= F.col("b_s"))
    return pairs.filter(meet & (floor_div(F.greatest("a_s", "b_s"), bucket) == F.col("bucket"))).select(_packed(left.columns, "a"), _packed(right.columns, "b"))


def cells_of(rects: DataFrame, cell: int) -> DataFrame:
    """Rows of rects with each cell (cx, cy) that they overlap."""
    low = lambda v: floor_div(col(v), cell)
    high = lambda v, s: floor_div(col(v) + col(s) - 1, cell)
    return rects.withColumn("cx", F.explode(F.sequence(low("x"), high("x", "w")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y", "h"))))


def first_zone(points: DataFrame, zones: DataFrame, order: str, bucket: int | None = None) -> DataFrame:
    """For each point (p, all its columns) the zone (r) of least `order` around it; points without zone drop out.

    Pairs carry numbers alone and are combined where they are made, without a sort; zones join the one order of each point.
    """
    slim = zones.select(*dict.fromkeys((order, "x", "y", "w", "h")))
    least = point_join(points, slim, bucket).groupBy(*(F.col(f"p.{c}").alias(f"p_{c}") for c in points.columns)).agg(F.min(f"r.{order}").alias("_least"))
    found = least.join(_flat(zones, "r"), F.col("_least") == F.col(f"r_{order}")).filter(in_rect("p_x", "p_y", "r_x", "r_y", "r_w", "r_h"))
    one = found.dropDuplicates([f"p_{c}" for c in points.columns])  # zones of equal order
    return one.select(_packed(points.columns, "p"), _packed(zones.columns, "r"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes (id); component is the least id that undirected edges (a, b) reach.

    Hooking and pointer jumping: labels fall to the least label around and then to their label's label, which takes
    logarithmically many rounds on chains; each round is checkpointed, and only labels that still change are counted.
    """
    both = reliable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = reliable(nodes.select(F.col("id"), F.col("id").alias("label")).distinct())
    while True:
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        hooked = labels.join(around.withColumnRenamed("a", "id"), "id", "left").select("id", "label", F.least("label", "least").alias("new"))
        # a label's own node may have found a lesser one: hook the whole tree, then jump
        roots = hooked.groupBy("label").agg(F.min("new").alias("root"))
        hooked = hooked.join(roots, "label").select("id", "label", F.least("new", "root").alias("new"))
        jump = hooked.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = reliable(hooked.join(jump, "new", "left").select("id", "label", F.least("new", "far").alias("new")))
        changed = not step.filter("label <> new").isEmpty()
        labels = step.select("id", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node) of all that a root reaches over edges (node, needs), itself too; cycles end.

    Steps double: in a round, what is reached in fewer than n steps is carried on by the pairs that lie n steps apart, so
    that rounds are as many as the logarithm of the longest way. A round writes only the pairs that are new.
    """
    ahead = reliable(edges.select("node", F.col("needs").alias("far")).dropna().distinct())
    parts = [reliable(start.select("root", F.col("root").alias("node")).distinct())]
    while True:
        seen = functools.reduce(DataFrame.union, parts)
        found = seen.join(ahead, "node").select("root", F.col("far").alias("node")).distinct()
        fresh = reliable(found.join(seen, ["root", "node"], "left_anti"))
        if fresh.isEmpty():
            return seen
        parts.append(fresh)
        further = ahead.select("node", F.col("far").alias("mid")).join(ahead.withColumnRenamed("node", "mid"), "mid")
        ahead = reliable(further.select("node", "far").distinct())
