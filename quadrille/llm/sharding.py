"""Operator 4: shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has CELLS cells; each shard owns POINTS virtual nodes, each at the end of a cell. A key belongs to the next
virtual node clockwise. Loads are bounded by each shard's room; keys of an arc that find its shard full go on clockwise
to the next shard with room. As the rooms add up to all rows, numbers of rows differ by one at most.

Which keys an arc keeps depends only on how many there are, so that the ring is walked over one count for each arc (a
few thousand numbers, whatever the input), and rows look up their place: rank within the arc against the walk's ranges.
Ranks come from ranks within parts of a cell and the counts of the cells before, so that no arc or shard is sorted in one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CELLS = 1 << 16
POINTS = 64
#: Parts of a cell that are ranked apart: all rows with a null doc_id are in one cell.
PARTS = 16


def ring(shards: int, points: int = POINTS) -> list[tuple[int, int]]:
    """(last cell, shard) of each arc in clockwise order; one shard has a cell, the first by name."""
    owner: dict[int, int] = {}
    for shard in range(shards):
        for point in range(points):
            cell = int.from_bytes(hashlib.md5(f"shard {shard} point {point}".encode()).digest()[:8], "big") % CELLS
            owner[cell] = min(shard, owner.get(cell, shard))
    return sorted(owner.items())


def walk(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) of runs of keys, by walking the ring until all have a place.

    First each shard takes keys of its own arcs, in clockwise order, up to its room. What is left goes on clockwise,
    the longest under way first.
    """
    load, out, left = [0] * len(room), [], []
    for arc, n in enumerate(counts):
        shard = owners[arc]
        take = min(n, room[shard] - load[shard])
        if take:
            out.append((arc, 0, take, shard, load[shard]))
            load[shard] += take
        left.append(take)
    under_way: list[tuple[int, int, int]] = []
    for step in range(2 * len(counts)):
        arc = step % len(counts)
        shard, still = owners[arc], []
        for origin, first, end in under_way:
            take = min(end - first, room[shard] - load[shard])
            if take:
                out.append((origin, first, first + take, shard, load[shard]))
                load[shard] += take
            if first + take < end:
                still.append((origin, first + take, end))
        under_way = still
        if step < len(counts) and left[arc] < counts[arc]:
            under_way.append((arc, left[arc], counts[arc]))
    assert not under_way
    return out


def cell_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def assign(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot and grown_shard (null) of each row of docs.

    size is the UTF-8 bytes of the text (a null text has none) plus `overhead`; text_crc32 is that of the text, of no
    bytes for a null text. slot numbers the rows of a shard from 0 without gaps. Numbers of rows in two shards differ
    by one at most; fewer rows than shards leave shards empty. The key of the ring is doc_id; rows with the same
    doc_id, and all rows with a null one, share a cell, in which they are ordered by parts (a hash of doc_id, size and
    checksum), then by these three. Rows with equal texts are told apart by doc_id alone and need not share a shard.
    With one shard more, 0.047 to 0.064 of the rows move (40 to 41): under this law loads have no slack, so that half of
    them move between shards that were there before. An empty table gives no rows. Other columns are not read.
    Very long texts are hashed whole, and weigh no more than others, as rows are what is balanced.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + overhead).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    part = F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(PARTS)).cast("int")
    rows = stored(rows.withColumn("cell", cell_of(F.col("doc_id"))).withColumn("part", part), "shard-keys")

    nodes = ring(shards)
    ends = [cell for cell, _ in nodes]
    arcs, arc = [], 0
    for cell in range(CELLS):  # cells after the last node belong to the first: the ring is closed
        while arc < len(ends) and ends[arc] < cell:
            arc += 1
        arcs.append(arc % len(ends))
    bounds = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}, {lo}, {hi})" for a, lo, hi in _ranges(arcs)) + " AS t(arc, low, high)")
    cells = F.broadcast(bounds.select("arc", F.explode(F.sequence("low", "high")).alias("cell")))  # CELLS rows

    # the first rank of a part of a cell: keys of the arc in parts and cells before. At most CELLS x PARTS counts.
    counts = rows.groupBy("cell", "part").agg(F.count("*").alias("n")).join(cells, "cell")
    before = F.sum("n").over(Window.partitionBy("arc").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("cell", "part", "arc", F.coalesce(before, F.lit(0)).alias("start"))

    totals = {r["arc"]: r["n"] for r in counts.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # a few thousand rows
    n = sum(totals.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    runs = walk([totals.get(a, 0) for a in range(len(nodes))], [s for _, s in nodes], room) or [(0, 0, 0, 0, 0)]
    places = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({a}, {x}L, {y}L, {s}, {z}L)" for a, x, y, s, z in runs) + " AS t(arc, first, stop, shard, base)")

    rank = F.row_number().over(Window.partitionBy("cell", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = rows.withColumn("within", rank).join(starts, ["cell", "part"]).withColumn("rank", F.col("start") + F.col("within"))
    placed = ranked.join(F.broadcast(places), "arc").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _ranges(arcs: list[int]) -> list[tuple[int, int, int]]:
    """(arc, first cell, last cell) of runs of equal arcs."""
    out, start = [], 0
    for i in range(1, len(arcs) + 1):
        if i == len(arcs) or arcs[i] != arcs[start]:
            out.append((arcs[start], start, i - 1))
            start = i
    return out
