"""Near copies by the stages' rule: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts are compared by operator 10's way: fingerprints in tiles, exclusive-or, bit counts within RADIUS. At 0.8 that
radius is too wide for blocks of bits to deal the tiles, and all pairs of tiles would grow with the square of the texts; so
that only texts meet that agree on one of BANDS bands of ROWS least hashes. At 0.8 a pair misses all bands with a
probability of 0.0004, at 0.85 of 0.00002. Each pair found is held against the sets themselves before it links.

So that a large group of copies costs no square of pairs, each text is first held against one partner, the nearest of the
least texts of its cells. What is then still in different components, but shares cells, makes a cluster; tiles of a
cluster compare all that is in different components, with the sets in the task, and only a forest of links leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, free_name, mix64, offsets, stored
from .components import components
from .simhash import SPAN, _tile_pairs, forest, majority, whole_cells
from .substring_dedup import BASE, run_hashes, word_hashes

SHINGLE = 5
SIMILAR = (4, 5)
#: At 0.8 of five-word shingles, fingerprints of three words differ in 7 bits about, with a deviation below 3.
RADIUS = 16
BANDS, ROWS = 20, 5
#: Texts of a cluster that are compared in one tile; more make several tiles.
TILE = 512
_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def text_key() -> Column:
    """Hash of a row's text; texts without words, null too, have the same one."""
    text = F.col("text").cast("string")
    return F.when(F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint"))


def shingles(texts: list[str], sizes: tuple[int, ...] = (SHINGLE,)) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of all shingles of so many words, and where those of each text start; shorter texts are one shingle."""
    split = [t.encode().lower().split() for t in texts]
    length = np.array([len(s) for s in split], np.int64)
    at = offsets(length)
    h = word_hashes(split) if at[-1] else np.zeros(0, np.uint64)
    out = []
    for n in sizes:
        runs = run_hashes(h, n, BASE)
        first = np.arange(len(runs))
        text = np.searchsorted(at, first, side="right") - 1
        inside = first + n <= at[text + 1]
        hashes, owner = [runs[inside]], [text[inside]]
        for k in range(1, n):  # texts of k words
            short = np.flatnonzero(length == k)
            if len(short):
                hashes.append(run_hashes(h, k, BASE)[at[short]])
                owner.append(short)
        hashes, owner = np.concatenate(hashes), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        out.append((hashes[order], offsets(np.bincount(owner, minlength=len(texts)))))
    return out


def sets(texts: list[str]) -> list[np.ndarray]:
    """Distinct shingles of each text."""
    hashes, at = shingles(texts)[0]
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def bands(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS cells of each text, hashes of ROWS least hashes each; zeros for texts without shingles."""
    out = np.zeros((len(at) - 1, BANDS), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k, factor in enumerate(_FACTORS):
            band = k // ROWS
            out[some, band] = mix64(out[some, band] * BASE + np.minimum.reduceat(hashes * factor, at[some]) + np.uint64(band))
    return out


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, fp, size (of the set of shingles) and cells of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            for a, b in chunks(map(len, texts), SPAN):
                three, five = shingles(texts[a:b], (3, SHINGLE))
                size = [len(np.unique(five[0][x:y])) for x, y in zip(five[1][:-1], five[1][1:], strict=True)]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(bands(*five).view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), batch["key"].slice(a, b - a), pa.array(majority(*three).view(np.int64)), pa.array(size, pa.int32()), cells], ["doc_id", "key", "fp", "size", "cells"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, key bigint, fp bigint, size int, cells array<bigint>")


def _pivots(cells: DataFrame) -> DataFrame:
    """One pair (a, b) for each key that has one: with the nearest of the least keys of its cells."""
    least = cells.groupBy("cell").agg(F.min(F.struct("key", "fp", "size")).alias("p"))
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp")))
    small, large = F.least("size", "p.size"), F.greatest("size", "p.size")
    near = cells.join(least, "cell").filter((F.col("key") != F.col("p.key")) & (bits <= RADIUS) & (SIMILAR[1] * small >= SIMILAR[0] * large))
    best = near.groupBy("key").agg(F.min(F.struct(bits.alias("bits"), F.col("p.key").alias("pivot"))).alias("m"))
    return best.select(F.least("key", "m.pivot").alias("a"), F.greatest("key", "m.pivot").alias("b")).distinct()


def _clusters(cells: DataFrame, nodes: DataFrame, reach: DataFrame, tile: int) -> DataFrame:
    """(cell, side, key, fp, component) of the tiles in which texts that share cells, in different components, meet."""
    whole = reach.withColumnRenamed("id", "key")
    rows = stored(cells.select("cell", "key").join(whole, "key", "left").select("cell", "key", F.coalesce("component", "key").alias("component")), "near-cells")
    mixed = rows.groupBy("cell").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("cell", "least")
    near = components(rows.join(mixed, "cell").select(F.col("component").alias("a"), F.col("least").alias("b")).distinct())
    own = rows.select("key", "component").distinct().join(near.toDF("component", "cell"), "component")
    members = stored(own.join(nodes.select("key", "fp"), "key"), "near-clusters")

    count = members.groupBy("cell", "component").agg(F.count("*").alias("c")).groupBy("cell").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("major"))
    rows = members.join(count, "cell")
    # a cluster with more texts than a tile: those of its largest component need no comparison with each other
    minor = F.col("component") != F.col("major.component")
    parts = lambda n: F.ceil(n / tile).cast("int")
    minors, majors = parts(F.col("n") - F.col("major.c")), parts(F.col("major.c"))
    part = F.pmod(F.xxhash64("key"), F.when(minor, minors).otherwise(majors)).cast("int")
    place = lambda kind, i, j, side: F.struct(F.xxhash64("cell", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    among = F.transform(upto(minors), lambda j: place(1, F.least(part, j), F.greatest(part, j), F.when(part < j, 1).when(part > j, 2).otherwise(0)))
    mixed = F.transform(upto(majors), lambda j: place(2, part, j, F.lit(1)))
    against = F.transform(upto(minors), lambda i: place(2, i, part, F.lit(2)))
    where = F.when(F.col("n") <= tile, F.array(F.struct("cell", F.lit(0).alias("side")))).when(minor, F.concat(among, mixed)).otherwise(against)
    return rows.select(F.explode(where).alias("t"), "key", "fp", "component").select("t.*", "key", "fp", "component")


def _shared_counts(own: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many shingles the sets x[i] and y[i] share: products of 0-1 matrices over what two sets or more have."""
    which = np.unique(np.concatenate([x, y]))
    size = np.array([len(own[i]) for i in which])
    _, column, times = np.unique(np.concatenate([own[i] for i in which]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(which)), size)
    some = times[column] > 1
    row, column = row[some], (np.cumsum(times > 1) - 1)[column[some]]
    both = np.zeros((len(which), len(which)), np.float32)  # counts stay far below what it holds exactly
    order = np.argsort(column, kind="stable")
    row, column, width = row[order], column[order], 4096
    for a in range(0, int(column.max(initial=-1)) + 1, width):
        low, high = np.searchsorted(column, (a, a + width))
        part = np.zeros((len(which), width), np.float32)
        part[row[low:high], column[low:high] - a] = 1
        both += part @ part.T
    return both[np.searchsorted(which, x), np.searchsorted(which, y)].astype(np.int64)


def _exact_links(tiles: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar texts of different components that meet in a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, 500):
            cell, side, key, fp, component = (table[c].to_numpy() for c in ("cell", "side", "key", "fp", "component"))
            at = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for low, high in zip(at[:-1], at[1:], strict=True):
                x, y = _tile_pairs(fp[low:high].view(np.uint64), side[low:high], RADIUS)
                keep = component[low + x] != component[low + y]
                x, y = x[keep], y[keep]
                if not len(x):
                    continue
                needed = np.unique(np.concatenate([x, y]))
                own: dict[int, np.ndarray] = {}
                spelled = table["text"].take(pa.array(low + needed))
                for a, b in chunks(pc.utf8_length(spelled).to_pylist(), SPAN):
                    own |= dict(zip(needed[a:b].tolist(), sets(spelled.slice(a, b - a).to_pylist()), strict=True))
                size = np.array([len(own.get(i, ())) for i in range(high - low)])
                shared = _shared_counts(own, x, y)
                good = SIMILAR[1] * shared >= SIMILAR[0] * (size[x] + size[y] - shared)
                a, b = forest(x[good], y[good], high - low)
                yield pa.RecordBatch.from_arrays([pa.array(key[low + a]), pa.array(key[low + b])], ["a", "b"])

    rows = tiles.join(texts, "key").select("cell", "side", "key", "fp", "component", "text")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            size = pc.add(pc.utf8_length(batch["text_a"]), pc.utf8_length(batch["text_b"])).to_pylist()
            for low, high in chunks(size, SPAN):  # a batch may hold many times the text that is looked at together
                rows = batch.slice(low, high - low)
                ok = []
                for key, own, other in zip(rows["b"].to_pylist(), sets(rows["text_a"].to_pylist()), rows["text_b"], strict=True):
                    if key != last:  # rows of one b stand together
                        last, held = key, sets([other.as_py()])[0]
                    ok.append(similar(own, held))
                yield pa.RecordBatch.from_arrays([rows["a"], rows["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def links(docs: DataFrame, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, component) of the keys that are linked."""
    cells = nodes.select("key", "fp", "size", F.explode("cells").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1").select("cell")
    cells = stored(cells.join(shared, "cell"), "near-cells")
    met = cells.select("key").distinct()
    texts = stored(docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).join(met, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "near-texts")
    first = cut(_verified(_pivots(cells), texts))
    reach = cut(components(first))
    return components(first.union(_exact_links(_clusters(cells, nodes, reach, tile), texts)))


def without_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of docs without near copies: of all texts that links reach, the one with the least (doc_id, hash of text) stays, once.

    Rows are told apart by id and text: of two texts under one id each has its own verdict. Equal texts are copies, and
    so are texts without words; a text of fewer than five words is one shingle. Repeated rows are one. Rows with a null
    doc_id take no part and stay. An empty table gives no rows. Other columns stay as they are, whatever their names.
    """
    marked = cut(_marked(docs))
    some = marked.filter("doc_id is not null")
    nodes = cut(some.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("cells").alias("cells")))
    reach = links(docs, nodes.filter("size > 0"), tile)
    own = nodes.select("key", "least").join(reach.withColumnRenamed("id", "key"), "key", "left")
    key, id_, rank = (free_name(n, docs) for n in ("_key", "_id", "_n"))
    best = own.groupBy(F.coalesce("component", "key").alias("c")).agg(F.min(F.struct("least", "key")).alias("k")).select(F.col("k.least").alias(id_), F.col("k.key").alias(key))
    rows = docs.withColumn(key, text_key()).withColumn(id_, F.col("doc_id").cast("bigint"))
    kept = rows.filter(F.col(id_).isNotNull()).join(best, [id_, key], "left_semi")
    once = Window.partitionBy(id_, key).orderBy(F.lit(1))
    kept = kept.withColumn(rank, F.row_number().over(once)).filter(F.col(rank) == 1)
    return kept.select(docs.columns).union(rows.filter(F.col(id_).isNull()).select(docs.columns))
