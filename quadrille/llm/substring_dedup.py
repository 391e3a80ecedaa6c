"""Operator 8: repeated passages by compressed FM-indexes over shards of text.

A document can only repeat what has the same words, so shards are made by content: each window of WINDOW words has an
anchor, the run of words in it with the least hash, and equal windows have equal anchors. Consecutive windows with one
anchor are a segment, and what is shared lies in segments whose anchor several documents have. Equal segments (128 bits
of hashes) are spelled and searched once, with their least document and their greatest.

A shard holds whole anchors and an FM-index of their segments: a wavelet matrix of the Burrows-Wheeler transform and one
of the documents in the order of suffixes, both packed bits. Each segment is streamed through its index by backward
search, which gives how far some smaller document goes along with it; matches of WINDOW words or more are reported.

Anchors of few words may be common. Where more than GROUP different segments share one, its segments are dealt again by
longer anchors (ANCHORS); those of WINDOW words have one segment each, so that groups are bounded whatever the text.
Results do not depend on GROUP. Only anchors, hashes and places are shuffled for most of the text; words are sent only for
segments that share an anchor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, free_name, mix64, offsets, stored

WINDOW = 50
#: Words of an anchor: the first for all text, each next for the segments of anchors that were too common.
ANCHORS = (25, 38, 46, WINDOW)
#: Different segments of an anchor that go to one index.
GROUP = 256
#: Words in an index, about.
INDEX_WORDS = 400_000
SPAN = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: For each place in a word of 64 bits, those below it.
BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
SPANS = "array<struct<a:int,b:int>>"


def word_hashes(split: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all words."""
    codes, distinct = pd.factorize(np.array([w for s in split for w in s] or [b""], object))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in distinct], np.uint64)[codes]


def run_hashes(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Hashes of all runs of n words, built from runs of powers of two."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, length, weight = None, 0, h, 1, base
    while length <= n:
        if n & length:
            part = power[done : done + size]
            out = part.copy() if out is None else out * weight + part
            done += length
        if 2 * length <= n:
            power = power[:-length] * weight + power[length:]
        length, weight = 2 * length, np.uint64(int(weight) ** 2 % (1 << 64))
    return mix64(out)


class Powers:
    """Powers of BASE and of its inverse, from 0 to n at least; one for all batches of a task."""

    def __init__(self):
        self.held = []

    def __call__(self, n: int) -> list[np.ndarray]:
        if not self.held or len(self.held[0]) <= n:
            self.held = []
            for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
                x = np.full(n + 1, base)
                x[0] = 1
                self.held.append(np.cumprod(x))
        return self.held


class Prefix:
    """Hashes of arbitrary runs of words."""

    def __init__(self, mixed: np.ndarray, powers: Powers | None = None):
        """mixed: mix64 of the words' hashes."""
        n = len(mixed)
        power, self.inverse = (powers or Powers())(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * power[:n], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * BASE2)


def segments(split: list[list[bytes]], anchor: int = ANCHORS[0]) -> tuple[np.ndarray, ...]:
    """anchor, hash, text number, start and words of all segments, for anchors of so many words."""
    split = [s if len(s) >= WINDOW else [] for s in split]
    at = offsets([len(s) for s in split])
    none = np.zeros(0, np.int64)
    if at[-1] < WINDOW:
        return none, none, none, none, none
    h = word_hashes(split)
    x = run_hashes(h, anchor, BASE)
    width = WINDOW - anchor + 1
    least = np.lib.stride_tricks.sliding_window_view(x, width).argmin(axis=1)
    first = np.arange(len(least))
    text = np.searchsorted(at, first, side="right") - 1
    valid = first + WINDOW <= at[text + 1]
    first, text, place = first[valid], text[valid], (first + least)[valid]
    change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(change[1:], len(place)) - 1
    a, b = first[change], first[last] + WINDOW
    return x[place[change]].view(np.int64), Prefix(mix64(h))(a, b).view(np.int64), text[change], a - at[text[change]], b - a


class Wavelet:
    """A wavelet matrix: for each bit of the values, highest first, packed bits and the number of ones before each 64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.words, self.ranks, self.zeros = [], [], []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = ones
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(packed)
            self.ranks.append((np.cumsum(np.bitwise_count(packed), dtype=np.int64) - np.bitwise_count(packed)).astype(np.int32))
            self.zeros.append(int(n - ones.sum()))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits of a level."""
        word = at >> 6
        return self.ranks[level][word] + np.bitwise_count(self.words[level][word] & BELOW[at & 63])

    def follow(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the occurrences of a value among the first `at` places end on the last level."""
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            ones = self._ones(level, at)
            at = np.where(value & (1 << bit), self.zeros[level] + ones, at - ones)
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of each non-empty range [low, high)."""
        both, out = np.concatenate([low, high]), np.zeros(len(low), np.int64)
        for level in range(self.bits):
            ones = self._ones(level, both)
            zeros = both - ones
            some = zeros[len(low) :] > zeros[: len(low)]
            out = 2 * out + ~some
            both = np.where(np.concatenate([some, some]), zeros, self.zeros[level] + ones)
        return out


class FMIndex:
    """An FM-index of segments of word codes (from 1) that knows the least document of what a pattern matches.

    Kept are two wavelet matrices and a count for each code: of the transformed text, and of the documents of the
    suffixes in their order. The text itself is not kept.
    """

    def __init__(self, parts: list[np.ndarray], documents: np.ndarray):
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        at = offsets(sizes)
        text = np.zeros(at[-1], np.int64)  # 0 ends each segment
        for p, a in zip(parts, at, strict=False):
            text[a : a + len(p)] = p
        order = self._sorted(text, at[1:] - 1)
        self.n = len(text)
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 2)
        self.transform = Wavelet(text[order - 1])
        self.documents, rank = np.unique(documents, return_inverse=True)
        self.owners = Wavelet(np.repeat(rank, sizes)[order])
        # a step of backward search goes to: suffixes with smaller codes + occurrences before the place
        self.base = np.concatenate([[0], np.cumsum(counts)])[: len(counts)] - self.transform.follow(np.arange(len(counts)), np.zeros(len(counts), np.int64))

    @staticmethod
    def _sorted(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffixes in order, by doubling; ends differ from each other, so that the order is complete when all have got theirs."""
        rank, width, n = text + len(ends), 1, len(text)
        rank[ends] = np.arange(len(ends))
        while True:
            second = np.zeros(n, np.int64)
            second[:-width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            width *= 2
            if rank[order[-1]] == n - 1 or width >= n:
                return order

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: suffixes that start with code and then with what [low, high) starts with."""
        both = self.transform.follow(np.concatenate([code, code]), np.concatenate([low, high])) + np.concatenate([self.base[code], self.base[code]])
        return both[: len(low)], both[len(low) :]

    def repeats(self, parts: list[np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, start, end) of the longest runs of WINDOW codes or more that documents below the part's limit have.

        For each part the match that ends at its last code is extended backwards as far as a smaller document goes
        along; then the same for the next end at which a window could reach further to the left.
        """
        at = offsets([len(p) for p in parts])
        text = np.concatenate([*parts, np.zeros(1, np.int64)])
        limit = np.searchsorted(self.documents, limits)  # in numbers of the documents here
        end = np.diff(at)
        own = np.flatnonzero((end >= WINDOW) & (limit > 0))
        end = end[own]
        start, low, high = end.copy(), np.zeros(len(own), np.int64), np.full(len(own), self.n)
        out = []
        while len(own):
            code = text[at[own] + np.maximum(start - 1, 0)]
            new_low, new_high = self.extend(code, low, high)
            longer = (start > 0) & (new_high > new_low)
            # as many suffixes as before one word less are of the same documents: no need to look again
            some = np.flatnonzero(longer & (new_high - new_low < high - low))
            longer[some] = self.owners.least(new_low[some], new_high[some]) < limit[own[some]]
            start = start - longer
            low, high = np.where(longer, new_low, 0), np.where(longer, new_high, self.n)
            hit = ~longer & (end - start >= WINDOW)
            out.append((own[hit], start[hit], end[hit]))
            over = ~longer & (start == 0)
            end = np.where(longer, end, np.where(hit, start + WINDOW - 1, end - 1))
            start = np.where(longer, start, end)
            keep = ~over & (end >= WINDOW)
            own, end, start, low, high = own[keep], end[keep], start[keep], low[keep], high[keep]
        part, a, b = (np.concatenate([np.zeros(0, np.int64), *(o[i] for o in out)]) for i in range(3))
        return part, a, b


def _find(docs: DataFrame) -> DataFrame:
    """(anchor, seg, doc_id, text_key, starts, n) of all distinct segments of each document: lines that go on repeating give one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            ids, keys = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()
            for a, b in chunks(map(len, texts), SPAN):
                anchor, seg, text, start, n = segments([t.encode().split() for t in texts[a:b]])
                order = np.lexsort((start, seg, anchor, text))
                anchor, seg, text, start, n = (v[order] for v in (anchor, seg, text, start, n))
                first = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(anchor) != 0) | (np.diff(seg) != 0)])) if len(text) else text
                starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), pa.array(start, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first]), pa.array(seg[first]), pa.array(ids[a + text[first]]), pa.array(keys[a + text[first]]), starts, pa.array(n[first], pa.int32())], ["anchor", "seg", "doc_id", "text_key", "starts", "n"])

    return docs.mapInArrow(run, "anchor bigint, seg bigint, doc_id bigint, text_key bigint, starts array<int>, n int")


def _shared(distinct: DataFrame, written: bool = False) -> DataFrame:
    """Segments (anchor, seg, keeper, last) whose anchor several documents have, with the anchor's number of segments and least document.

    Where distinct is a written table, so are the anchors: a join of two written tables can split hot keys.
    """
    shared = distinct.groupBy("anchor").agg(F.count("*").alias("segs"), F.min("keeper").alias("least"), F.max("last").alias("most")).filter("least < most").drop("most")
    return distinct.join(stored(shared, "anchors") if written else shared, "anchor")


def _spell(docs: DataFrame) -> DataFrame:
    """Words of the segments listed with each document."""
    names = ["anchor", "seg", "keeper", "last", "segs", "least", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, wanted in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                words = text.encode().split()
                for w in wanted:
                    rows.append((w["anchor"], w["seg"], doc_id, w["last"], w["segs"], w["least"], b" ".join(words[w["start"] : w["start"] + w["n"]])))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names)

    return docs.mapInArrow(run, "anchor bigint, seg bigint, keeper bigint, last bigint, segs bigint, least bigint, words binary")


def _dealt_again(rows: DataFrame, anchor: int) -> DataFrame:
    """Segments by anchors of so many words within spelled segments; whole_anchor, whole_seg and place tell where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [w.split(b" ") for w in batch["words"].to_pylist()]
            for low, high in chunks(map(len, split), SPAN // 8):
                own, seg, text, start, n = segments(split[low:high], anchor)
                words = [b" ".join(split[low + t][s : s + k]) for t, s, k in zip(text.tolist(), start.tolist(), n.tolist(), strict=True)]
                taken = batch.take(pa.array(low + text))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seg), taken["keeper"], taken["last"], pa.array(words, pa.binary()), taken["anchor"], taken["seg"], pa.array(start, pa.int32())], ["anchor", "seg", "keeper", "last", "words", "whole_anchor", "whole_seg", "place"])

    return rows.mapInArrow(run, "anchor bigint, seg bigint, keeper bigint, last bigint, words binary, whole_anchor bigint, whole_seg bigint, place int")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Builds an index of every INDEX_WORDS words, about, without parting an anchor, and streams its segments."""
    held: list[tuple] = []
    total = 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("anchor", "seg", "keeper", "last", "least", "words")), strict=True):
            if total >= INDEX_WORDS and row[0] != held[-1][0]:
                yield _shard(held)
                held, total = [], 0
            words = row[5].split(b" ")
            held.append((*row[:5], words))
            total += len(words)
    if held:
        yield _shard(held)


def _shard(held: list[tuple]) -> pa.RecordBatch:
    """anchor, seg, keeper and what of the segment smaller documents have: than the keeper (own), than all others that have it (others)."""
    codes, _ = pd.factorize(np.array([w for row in held for w in row[5]], object))
    parts = np.split(codes.astype(np.int64) + 1, np.cumsum([len(row[5]) for row in held])[:-1])
    keeper, last, least = (np.array([row[i] for row in held], np.int64) for i in (2, 3, 4))
    index = FMIndex(parts, keeper)
    columns = []
    for which, limit in ((np.flatnonzero(keeper > least), keeper), (np.flatnonzero(last > keeper), last)):
        part, a, b = index.repeats([parts[i] for i in which], limit[which])
        order = np.argsort(part, kind="stable")
        count = np.zeros(len(held), np.int64)
        count[which] = np.bincount(part, minlength=len(which))
        pair = pa.StructArray.from_arrays([pa.array(a[order], pa.int32()), pa.array(b[order], pa.int32())], ["a", "b"])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets(count), pa.int32()), pair))
    return pa.RecordBatch.from_arrays([pa.array([row[0] for row in held], pa.int64()), pa.array([row[1] for row in held], pa.int64()), pa.array(keeper), *columns], ["anchor", "seg", "keeper", "own", "others"])


def _shifted(spans, by):
    return F.transform(spans, lambda s: F.struct((s["a"] + by).cast("int").alias("a"), (s["b"] + by).cast("int").alias("b")))


def _decided(spelled: DataFrame, level: int, group: int) -> DataFrame:
    """(anchor, seg, keeper, own, others) of spelled segments, one row each: what smaller documents have than the keeper, than the others."""
    few, many = spelled.filter(F.col("segs") <= group), spelled.filter(F.col("segs") > group)
    out = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search, f"anchor bigint, seg bigint, keeper bigint, own {SPANS}, others {SPANS}")
    if level + 1 == len(ANCHORS) or many.isEmpty():  # anchors as long as a window have one segment
        return out
    parts = stored(_dealt_again(many, ANCHORS[level + 1]), "dealt-again")
    distinct = stored(parts.groupBy("anchor", "seg").agg(F.min("keeper").alias("keeper"), F.max("last").alias("last"), F.first("words").alias("words")), "distinct-again")
    below = _decided(stored(_shared(distinct, True), "spelled-again"), level + 1, group)
    found = parts.join(below.withColumnRenamed("keeper", "first"), ["anchor", "seg"])
    own = F.when(F.col("keeper") > F.col("first"), F.col("others")).otherwise(F.col("own"))
    found = found.select("whole_anchor", "whole_seg", "keeper", _shifted(own, F.col("place")).alias("own"), _shifted(F.col("others"), F.col("place")).alias("others"))
    # the parts of one segment, WINDOW + 1 at most
    whole = found.groupBy(F.col("whole_anchor").alias("anchor"), F.col("whole_seg").alias("seg"), "keeper").agg(F.flatten(F.collect_list("own")).alias("own"), F.flatten(F.collect_list("others")).alias("others"))
    return out.union(whole)


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, spans) of documents with repeated passages: spans are an array of (a, b), words a to b - 1 in no order, that may overlap.

    docs has doc_id, text and text_key (a hash of the text, for ids that are repeated), none of them null. Repeated rows
    count once.
    """
    rows = stored(_find(docs), "segments")
    least = F.min(F.struct("doc_id", "text_key", F.col("starts")[0].alias("start"), "n")).alias("m")
    # equal segments count once, before the shuffle already
    distinct = rows.groupBy("anchor", "seg").agg(least, F.max("doc_id").alias("last")).select("anchor", "seg", "m.text_key", "m.start", "m.n", F.col("m.doc_id").alias("keeper"), "last")
    entry = F.struct("anchor", "seg", "start", "n", "last", "segs", "least")
    wanted = _shared(distinct).groupBy(F.col("keeper").alias("doc_id"), "text_key").agg(F.collect_list(entry).alias("wanted"))  # of one document
    matched = docs.join(wanted, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    verdict = stored(_decided(stored(_spell(matched), "spelled"), 0, group), "verdict")  # so that the join below starts from two shuffles, whose hot keys can be split

    spans = F.when(F.col("doc_id") > F.col("keeper"), F.col("others")).otherwise(F.col("own"))
    hit = rows.join(verdict.filter(F.size("own") + F.size("others") > 0), ["anchor", "seg"]).withColumn("found", spans).filter(F.size("found") > 0)
    placed = F.flatten(F.transform("starts", lambda at: _shifted(F.col("found"), at)))
    return hit.select("doc_id", "text_key", placed.alias("spans")).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))  # of one document


def with_spans(docs: DataFrame, name: str = "_spans", group: int = GROUP) -> DataFrame:
    """docs (all its columns) with a column of this name, which docs must not have: the spans, null where nothing is repeated."""
    text = F.col("text").cast("string")
    own, key = free_name("_id", docs, name), free_name("_key", docs, name)
    keyed = docs.withColumn(own, F.col("doc_id").cast("bigint")).withColumn(key, F.xxhash64(text))
    found = repeats(keyed.filter("doc_id is not null and text is not null").select(F.col(own).alias("doc_id"), text.alias("text"), F.col(key).alias("text_key")), group)
    return keyed.join(found.toDF(own, key, name), [own, key], "left").drop(own, key)


def removed(n: int, spans) -> np.ndarray:
    """Which of n words the spans cover."""
    delta = np.zeros(n + 1, np.int64)
    for s in () if spans is None else spans:
        delta[s["a"]] += 1
        delta[s["b"]] -= 1
    return np.cumsum(delta[:-1]) > 0


def deduplicate(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs.

    Words are runs of characters other than ASCII white space, unchanged. A word is removed if a window of WINDOW
    consecutive words that covers it is also in a document with a smaller doc_id; windows are judged on the input. The
    digest is of the kept words, joined by one space, in UTF-8. A null or empty text has no words; shorter texts than
    a window keep all. Rows with a null doc_id keep all and repeat nothing; rows with equal doc_id don't repeat each
    other. Each row gives a row; an empty table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["_spans"].to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = removed(len(words), spans) if spans else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, cut_, digest = map(list, zip(*out, strict=True)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(cut_, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(own, group=group).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_spans(text: str | None, spans) -> str | None:
    """The text without the words that spans cover; white space before a removed word goes with it, all else stays."""
    if text is None or spans is None:
        return text
    data = text.encode()
    found = list(SPACE.finditer(data))
    gone = removed(len(found), spans)
    out, at = [], 0
    for match, g in zip(found, gone.tolist(), strict=True):
        if not g:
            out.append(data[at : match.end()])
        at = match.end()
    return b"".join([*out, data[at:]]).decode()
