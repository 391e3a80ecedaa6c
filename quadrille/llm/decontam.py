"""Operator 6: benchmark decontamination by greedy string tiling.

Documents are joined to benchmark items by shared seeds: SEED consecutive words that both have. Of each pair that shares
enough seeds to reach the threshold at all, greedy string tiling marks the longest matches that don't overlap, again and
again, found by running Karp-Rabin hashes of a length that falls; the share of the item that tiles cover decides. Tiles may lie anywhere in the document, so
that reordered passages count.

The benchmark is the stated query set: it goes out in blocks of bounded bytes, and each block meets all documents once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, gathered, mix64, offsets

SEED = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
SPAN = 1 << 19
SCHEMA = "doc_id bigint, item_id bigint, item_words int, covered_words int, coverage double, n_tiles int, longest int"
WORD = re.compile(r"\w+")
#: An odd factor and its inverse in arithmetic of 64 bits.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Elements that are compared at once.
COMPARED = 1 << 20


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return WORD.findall(text.lower())


def tiles(item: np.ndarray, document: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in document, length) of greedy tiles of at least `least` elements.

    The search length starts at the item's and is halved when a scan finds no match, down to `least`. A scan joins the
    running hashes (Karp-Rabin) of all unmarked runs of the search length and finds how far each candidate goes; all of
    the longest matches that don't overlap are marked, from left to right: ties go to the smaller place in the item, then
    in the document.
    """
    item, document = np.asarray(item, np.int64), np.asarray(document, np.int64)
    free_i, free_d, out = np.ones(len(item), bool), np.ones(len(document), bool), []
    search = max(least, min(len(item), len(document)))
    while True:
        longest, found = _longest(item, document, free_i, free_d, search)
        for i, js in found:
            if not free_i[i : i + longest].all():
                continue
            taken = np.append(0, np.cumsum(~free_d))
            js = js[taken[js + longest] == taken[js]]
            if len(js):
                j = int(js[0])
                free_i[i : i + longest] = free_d[j : j + longest] = False
                out.append((i, j, longest))
        if not found:
            if search == least:
                return out
            search = max(least, search // 2)


def _longest(item: np.ndarray, document: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, n: int) -> tuple[int, list]:
    """The greatest length from n on of a match of unmarked elements, and (start in item, starts in document) of all such.

    A candidate goes one further than the one behind both its starts, or else n: a run of equal elements costs a step for
    each of its candidates, not one for each of their elements.
    """
    at_i, hash_i = _running(item, free_i, n)
    at_d, hash_d = _running(document, free_d, n)
    known = np.isin(hash_d, hash_i)
    at_d, hash_d = at_d[known], hash_d[known]
    order = np.argsort(hash_d, kind="stable")
    at_d, hash_d = at_d[order], hash_d[order]
    low, high = np.searchsorted(hash_d, hash_i), np.searchsorted(hash_d, hash_i, side="right")
    length, before, last = np.zeros(len(document) + 1, np.int64), np.zeros(0, np.int64), -1
    longest, found = n - 1, []
    for k in np.flatnonzero(high > low)[::-1]:
        i, js = int(at_i[k]), at_d[low[k] : high[k]]
        behind = length[js + 1] if last == i + 1 else np.zeros(len(js), np.int64)
        length[before] = 0
        holds = np.where(behind > 0, document[js] == item[i], False)  # hashes are held against the elements
        first, step = np.flatnonzero(behind == 0), max(1, COMPARED // n)
        for at in range(0, len(first), step):
            alone = first[at : at + step]
            holds[alone] = (document[js[alone][:, None] + np.arange(n)] == item[i : i + n]).all(axis=1)
        js, own = js[holds], np.where(behind > 0, behind + 1, n)[holds]
        length[js], before, last = own, js, i
        if len(js) and own.max() >= longest:
            if own.max() > longest:
                longest, found = int(own.max()), []
            found.append((i, js[own == longest]))
    return longest, found[::-1]


def _running(codes: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of all runs of n unmarked elements: differences of running sums, each shifted to the same power."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, back = (np.cumprod(np.append(np.uint64(1), np.full(len(codes) - 1, f, np.uint64))) for f in (FACTOR, INVERSE))
    total = np.append(np.uint64(0), np.cumsum(mix64(codes.astype(np.uint64)) * up))
    taken = np.append(0, np.cumsum(~free))
    starts = np.flatnonzero(taken[n:] == taken[:-n])
    return starts, (total[starts + n] - total[starts]) * back[starts]


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int):
        self.items, self.seed, self.vocabulary = items, seed, {}
        codes = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for _, ws in items]
        self.least = [min(seed, len(ws)) for _, ws in items]  # shorter items are their own seed
        self.lengths = sorted(set(self.least) - {0})
        self.tables = {}
        for n in self.lengths:
            keys, owner, place = [], [], []
            for k, c in enumerate(codes):
                if self.least[k] == n:
                    h = self.hashes(c, n)
                    keys.append(h)
                    owner.append(np.full(len(h), k))
                    place.append(np.arange(len(h)))
            key, owner, place = np.concatenate(keys), np.concatenate(owner), np.concatenate(place)
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], owner[order], place[order]
        self.codes = codes

    @staticmethod
    def hashes(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n codes, the seeds; 0 where a word is none of the benchmark's."""
        if len(codes) < n:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(len(codes) - n + 1, np.uint64), np.ones(len(codes) - n + 1, bool)
        for j in range(n):
            part = codes[j : j + len(h)]
            h = h * np.uint64(0x100000001B3) + part.astype(np.uint64)
            known &= part > 0
        return np.where(known, mix64(h) | np.uint64(1), np.uint64(0))

    def matches(self, texts: list[str], threshold: float) -> Iterator[tuple]:
        """(text number, item number, words covered, tiles, longest) of the pairs whose tiles cover enough of the item."""
        split = [words(t) for t in texts]
        at = offsets([len(s) for s in split])
        get = self.vocabulary.get
        codes = np.fromiter((get(w, 0) for s in split for w in s), np.int64, at[-1])
        for n in self.lengths:
            key, owner, place = self.tables[n]
            h = self.hashes(codes, n)
            start = np.flatnonzero(h)
            text = np.searchsorted(at, start, side="right") - 1
            inside = start + n <= at[text + 1]
            start, text = start[inside], text[inside]
            low, high = np.searchsorted(key, h[start]), np.searchsorted(key, h[start], side="right")
            some = high > low
            if not some.any():
                continue
            low, high, text = low[some], high[some], text[some]
            times = high - low
            row = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(offsets(times)[:-1], times)
            # distinct (text, item, place of the seed in the item): an upper bound of what tiles can cover
            pair = np.unique(np.stack([np.repeat(text, times), owner[row], place[row]], axis=1), axis=0)
            cut = np.flatnonzero(np.any(np.diff(pair[:, :2], axis=0), axis=1)) + 1
            for group in np.split(pair, cut):
                t, k = int(group[0, 0]), int(group[0, 1])
                size = len(self.codes[k])
                cover = np.zeros(size + n, bool)
                for j in range(n):
                    cover[group[:, 2] + j] = True
                if cover.sum() < threshold * size:
                    continue
                document = codes[at[t] : at[t + 1]]
                found = tiles(self.codes[k], document, n)
                covered = sum(x[2] for x in found)
                if covered >= threshold * size:
                    yield t, k, covered, len(found), max(x[2] for x in found)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each pair of a document and a benchmark item whose tiles cover at least `threshold` of the item's words.

    Returns doc_id, item_id, item_words, covered_words, coverage, n_tiles and longest (tile). Words are runs of letters,
    digits and underscores in lower case; items of fewer than `seed` words match only as a whole, items without words
    (null, empty) never. A null doc_id is reported as such; repeated rows are each reported; repeated items too. Empty tables
    give no rows. Other columns are not read.
    Very long texts are tiled whole, a text beyond a block's size in a block of its own.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))

    def scans() -> Iterator[DataFrame]:
        for b in range(blocks):
            own = [(r["item_id"], words(r["text"])) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
            yield _scan(docs, [x for x in own if x[1]], seed, threshold)

    return gathered(scans(), blocks, "leaks")


def _scan(docs: DataFrame, items: list, seed: int, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, seed)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), [x or "" for x in batch["text"].to_pylist()]
            for a, b in chunks(map(len, texts), SPAN):
                rows = []
                for t, k, covered, n, longest in index.matches(texts[a:b], threshold):
                    item, own = index.items[k]
                    rows.append((ids[a + t], item, len(own), covered, covered / len(own), n, longest))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
