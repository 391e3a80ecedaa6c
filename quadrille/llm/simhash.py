"""Operator 10: SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared in tiles with exclusive-or and bit counts, and tiles whose population counts differ beyond
the radius are not compared. To keep the work near the number of fingerprints, tiles only hold fingerprints that agree
on some of the blocks that the bits are split in: with `blocks` blocks and radius r, two fingerprints within r agree on
blocks - r of them, so that comparing within each choice of blocks finds every link. What is compared are distinct
fingerprints, so that exact copies cost nothing; values of blocks that many fingerprints share are cut into tiles by
population count and hash, and each pair of tiles is a row group of its own. From each tile leaves a spanning forest of
its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, offsets
from .components import components

RADIUS = 3
SHINGLE = 3
#: Fingerprints in a tile, about; a row group holds two tiles.
TILE = 1024
SPAN = 1 << 19


def _hashes(text: str, shingle: int) -> list[int]:
    words = text.encode().lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return []
    data = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(data, 42)]
    start = offsets([len(w) + 1 for w in words])
    begin, end = start[: len(words) - shingle + 1].tolist(), (start[shingle:] - 1).tolist()
    return [digest(data[a:b], 42) for a, b in zip(begin, end, strict=True)]


def majority(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes, at[i] to at[i + 1]: a bit is set if it is set in more than half; 0 for empty runs."""
    out = np.zeros(len(at) - 1, np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int32)
        most = 2 * ones > np.diff(at)[some][:, None]
        out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts; 0 for those without words."""
    hashes = [_hashes(t, shingle) for t in texts]
    return majority(np.array([x for h in hashes for x in h], np.uint64), offsets([len(h) for h in hashes]))


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            found = [fingerprints(texts[a:b], shingle) for a, b in chunks(map(len, texts), SPAN)]
            fp = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _tile_pairs(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) within the radius of a tile (side all 0) or between two (sides 1 and 2), each once."""
    count = np.bitwise_count(fp).astype(np.int16)
    order = np.argsort(count, kind="stable")
    step = 256
    hits = [(order[:0], order[:0])]
    for i in range(0, len(order), step):
        left = order[i : i + step]
        for j in range(i, len(order), step):
            right = order[j : j + step]
            if count[right[0]] - count[left[-1]] > radius:
                break  # population counts of all later tiles differ more
            near = np.bitwise_count(fp[left][:, None] ^ fp[right][None, :]) <= radius
            if i == j:
                near = np.triu(near, 1)
            if side.any():
                near &= side[left][:, None] != side[right][None, :]
            x, y = np.nonzero(near)
            hits.append((left[x], right[y]))
    return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def _spanning(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect what is linked within a tile or between two."""
    return forest(*_tile_pairs(fp, side, radius), len(fp))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """No more than 2 n links that connect the same of n rows as links (a, b) do."""
    if len(a) <= 2 * n:
        return a, b
    label = np.arange(n)
    while True:  # least label over links until nothing changes: a star for each local component
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    i = np.flatnonzero(label != np.arange(n))
    return i, label[i]


def compared(cell: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, pairs=_tile_pairs) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) within the radius of each run of equal cells; `pairs` compares a run of more than 32 rows."""
    at = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
    size = np.diff(at)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    where = np.flatnonzero(np.repeat(size <= 32, size))
    for shift in range(1, 32):  # all small cells at once: each row with the one `shift` rows on
        where = where[where + shift < len(cell)]
        where = where[cell[where] == cell[where + shift]]
        if not len(where):
            break
        near = np.bitwise_count(fp[where] ^ fp[where + shift]) <= radius
        near &= (side[where] == 0) | (side[where] != side[where + shift])
        a.append(where[near])
        b.append(where[near] + shift)
    for k in np.flatnonzero(size > 32):
        x, y = pairs(fp[at[k] : at[k + 1]], side[at[k] : at[k + 1]], radius)
        a.append(x + at[k])
        b.append(y + at[k])
    return np.concatenate(a), np.concatenate(b)


def whole_cells(batches: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.Table]:
    """Batches sorted by cell as tables of about so many rows or more, which don't part a cell."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = table["cell"][-1].as_py()
        whole = int(np.searchsorted(table["cell"].to_numpy(), last)) if table["cell"][0].as_py() != last else 0
        if whole:  # the last cell may go on
            yield table.slice(0, whole)
            held, rows = table.slice(whole).to_batches(), table.num_rows - whole
    if rows:
        yield pa.Table.from_batches(held)


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            cell, fp, rep, side = (rows[c].to_numpy() for c in ("cell", "fp", "rep", "side"))
            x, y = compared(cell, fp.view(np.uint64), side, radius, _spanning)
            yield pa.RecordBatch.from_arrays([pa.array(rep[x]), pa.array(rep[y])], ["a", "b"])

    return run


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (a, b) between `rep` ids of distinct fingerprints (fp, rep) that connect all pairs within `radius` bits.

    Any number of blocks above the radius finds all links. Where it isn't given it follows the number of fingerprints: for
    3 bits each has 4 copies, 10 from 2^24 fingerprints and 20 from 2^30, so that what they agree on stays rare.
    """
    if blocks is None:  # enough bits in common that a value of the chosen blocks stays rare
        n = distinct.count()
        blocks = radius + (1 if n < 1 << 24 else 2 if n < 1 << 30 else 3)
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))
    masks = [sum(((1 << (edge[b + 1] - edge[b])) - 1) << edge[b] for b in c) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))
    pop = F.bit_count("fp").cast("int")
    rows = distinct.select("fp", "rep", F.explode(keys).alias("cell"), pop.alias("pop"))
    full = rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    rows = cut(rows.join(full, "cell", "left"))
    plain = rows.filter("n is null").select("cell", "fp", "rep", F.lit(0).alias("side"))
    # values of blocks with more rows than a tile: tiles by population count, then by hash
    heavy = rows.filter("n is not null")
    tiles = heavy.groupBy("cell", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    heavy = heavy.join(tiles, ["cell", "pop"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    name = tiles.select("cell", "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left, right = name.toDF("cell", "pop1", "part1"), name.toDF("cell", "pop2", "part2")
    pairs = left.join(right, "cell").filter((F.col("pop2") - F.col("pop1")).between(0, radius) & ((F.col("pop1") < F.col("pop2")) | (F.col("part1") <= F.col("part2"))))
    pairs = pairs.withColumn("pair", F.xxhash64("cell", "pop1", "part1", "pop2", "part2"))
    same = (F.col("pop1") == F.col("pop2")) & (F.col("part1") == F.col("part2"))
    ends = pairs.select("cell", F.col("pop1").alias("pop"), F.col("part1").alias("part"), "pair", F.when(same, 0).otherwise(1).alias("side")).union(pairs.filter(~same).select("cell", "pop2", "part2", "pair", F.lit(2)))
    tiled = heavy.join(ends, ["cell", "pop", "part"]).select(F.col("pair").alias("cell"), "fp", "rep", "side")
    return plain.union(tiled).repartition("cell").sortWithinPartitions("cell").mapInArrow(_links(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits) and component_id of each row of docs.

    Words are split at ASCII white space after lower-casing A-Z; a text with fewer words than a shingle is one shingle,
    one without words (or null) has the fingerprint 0 and links like any other. Two rows link if their fingerprints
    differ in at most `radius` bits; component_id is the least doc_id that links reach. Rows with a null doc_id take no
    part and have a null component_id; repeated rows each give a row. An empty table gives no rows. Other columns are
    not read.
    Very long texts are hashed whole, a text beyond a block's size in a block of its own.
    """
    marked = cut(with_fingerprint(docs, shingle))
    distinct = cut(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    reach = components(near_links(distinct, radius, blocks, tile))
    group = distinct.join(reach, distinct["rep"] == reach["id"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return marked.join(group, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known)
