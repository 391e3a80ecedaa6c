"""Operator 12: repeated byte strings by suffix arrays that are sorted by external induction.

Shards are made by content: a window of WINDOW bytes has an anchor, the run of bytes in it with the least hash (the first
of equals), and equal windows have equal anchors. Consecutive windows with one anchor are a segment. Anchors are counted
first; only segments whose anchor occurs more than once are looked at again (a bitmap of fixed size tells which, and lets
some others through). Equal segments (128 bits of hashes) count once: all but the first are removed whole. Only places are
shuffled for this; bytes are sent for first segments that share their anchor with different ones.

The different segments of an anchor go to one shard, whose suffixes induced.sort puts in order with their common
prefixes; suffixes that share WINDOW bytes stand together, and all but the first of them in the corpus lose these bytes.
Where more than GROUP different segments share an anchor, they are dealt again by longer ones (ANCHORS); those of WINDOW
bytes have one segment each, so that groups are bounded whatever the text. Results do not depend on GROUP or SHARD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import induced
from .bitmaps import COUNTERS, bitmap, counter_rows, merged
from .bitmaps import bit as bit_of
from .common import chunks, mix64, offsets, stored
from .substring_dedup import BASE, Powers, Prefix, run_hashes

WINDOW = 100
#: Bytes of an anchor: the first for all text, each next for the segments of anchors that were too common.
ANCHORS = (24, 60, 84, WINDOW)
#: Different segments of an anchor that go to one shard.
GROUP = 8192
#: Bytes in a shard, about, and bits of the filter of shared anchors, as a power of two.
SHARD = 700_000
FILTER = 27
SPAN = 1 << 20
PLACES = "anchor bigint, seg bigint, doc_id bigint, text_key bigint, start bigint, n bigint"
SEGMENTS = f"{PLACES}, data binary"
#: Bytes, counted from 1 so that zeros count too, scrambled for hashes of runs.
_MIXED = mix64(np.arange(1, 257, dtype=np.uint64))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    out, done = x, 1
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - done : width - done + n])


def anchors(data: np.ndarray, at: np.ndarray, anchor: int) -> tuple[np.ndarray, ...]:
    """anchor, text number, first and last window of all segments of texts that lie one behind the other from `at`."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none
    x = run_hashes(data.astype(np.uint64) + np.uint64(1), anchor, BASE)
    width = WINDOW - anchor + 1
    value = _least(x, width)
    valid = np.ones(len(value), bool)  # windows within one text
    for end in at[1:-1].tolist():
        valid[max(0, end - WINDOW + 1) : end] = False
    change = valid.copy()
    change[1:] &= (value[1:] != value[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change)
    if not len(first):
        return none, none, none, none
    last = _ends(first, valid)
    place = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, width)[first[a : a + 4096]].argmin(axis=1) for a in range(0, len(first), 4096)]) + first
    again = np.flatnonzero(last > place)  # the value occurs again further on
    if len(again):
        cuts = [first]
        for a, b in zip(first[again].tolist(), last[again].tolist(), strict=True):
            where = np.flatnonzero(x[a : b + width] == value[a]) + a
            own = where[np.searchsorted(where, np.arange(a, b + 1))]
            cuts.append(a + 1 + np.flatnonzero(own[1:] != own[:-1]))
        first = np.sort(np.concatenate(cuts), kind="stable")
        last = _ends(first, valid)
    return value[first].view(np.int64), np.searchsorted(at, first, side="right") - 1, first, last


def _ends(first: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The last window of each segment: before the next segment, and before windows that reach beyond their text."""
    gaps = np.flatnonzero(~valid[1:] & valid[:-1]) + 1  # where such windows begin
    behind = np.append(gaps, len(valid))[np.searchsorted(gaps, first, side="right")]
    return np.minimum(np.append(first[1:], len(valid)), behind) - 1


def _place(anchor: np.ndarray) -> np.ndarray:
    """The bit of each anchor in the filter; anchors are least hashes, so that they are scattered anew."""
    return (mix64(anchor.view(np.uint64)) >> np.uint64(64 - FILTER)).astype(np.int64)


def _known(anchor, seg, doc_id, start) -> np.ndarray:
    """The bit of a segment at its place in the filter of segments to be spelled."""
    key = np.zeros(len(anchor), np.uint64)
    for part in (anchor, seg, doc_id, start):
        key = mix64((key * BASE) ^ np.asarray(part, np.int64).view(np.uint64))
    return (key >> np.uint64(64 - FILTER)).astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bytes]]:
    """Rows (a part of a batch), their texts' bytes joined, and where each begins."""
    for batch in batches:
        texts = [t.encode() if isinstance(t, str) else t for t in batch[column].to_pylist()]
        for a, b in chunks(map(len, texts), SPAN):
            raw = b"".join(texts[a:b])
            yield batch.slice(a, b - a), np.frombuffer(raw, np.uint8), offsets([len(t) for t in texts[a:b]]), raw


def _shared_anchors(docs: DataFrame) -> np.ndarray:
    """Bits of the anchors that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at, _ in _batches(batches, "text"):
            anchor, n = np.unique(anchors(data, at, ANCHORS[0])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n, pa.int64())], ["anchor", "n"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield counter_rows(_place(batch["anchor"].to_numpy()))

    shared = docs.select("text").mapInArrow(count, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    return bitmap(merged(shared.mapInArrow(bits, COUNTERS), 1, FILTER), FILTER)


def _rows(batch: pa.RecordBatch, raw: bytes | None, at, anchor, seg, text, first, end) -> pa.RecordBatch:
    """Segments as rows of PLACES, or SEGMENTS with their bytes; starts go on from the batch's own, where it has them."""
    ids, keys = (batch[c].to_numpy()[text] for c in ("doc_id", "text_key"))
    start = first - at[text] + (batch["start"].to_numpy()[text] if "start" in batch.schema.names else 0)
    columns = [pa.array(c, pa.int64()) for c in (anchor, seg, ids, keys, start, end - first)]
    if raw is not None:
        columns.append(pa.array([raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["anchor", "seg", "doc_id", "text_key", "start", "n", "data"][: len(columns)])


def _hash(data: np.ndarray, first: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return Prefix(_MIXED[data], powers)(first, end).view(np.int64)


def _segments(batch: pa.RecordBatch, data, at, shared, powers: Powers) -> tuple[np.ndarray, ...]:
    """anchor, seg, text, first byte and end of the segments whose anchor may be shared."""
    anchor, text, first, last = anchors(data, at, ANCHORS[0])
    some = bit_of(shared, _place(anchor))
    anchor, text, first, end = anchor[some], text[some], first[some], last[some] + WINDOW
    return anchor, _hash(data, first, end, powers), text, first, end


def _find(docs: DataFrame, shared) -> DataFrame:
    """Places of segments whose anchor is shared; those that a document has had before have no anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, at, _ in _batches(batches, "text"):
            anchor, seg, text, first, end = _segments(batch, data, at, shared.value, powers)
            if not len(anchor):
                continue
            order = np.lexsort((first, seg, anchor, text))
            anchor, seg, text, first, end = (v[order] for v in (anchor, seg, text, first, end))
            repeated = np.append(False, (np.diff(text) == 0) & (np.diff(anchor) == 0) & (np.diff(seg) == 0))
            yield _rows(batch, None, at, *(v[~repeated] for v in (anchor, seg, text, first, end)))
            if repeated.any():
                own = _rows(batch, None, at, *(v[repeated] for v in (anchor, seg, text, first, end)))
                gone = pa.nulls(own.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([gone, gone, *own.columns[2:]], own.schema.names)

    return docs.mapInArrow(run, PLACES)


def _spelled(docs: DataFrame, shared, wanted: DataFrame) -> DataFrame:
    """The wanted segments (anchor, seg, doc_id, start) with their bytes, by reading the texts again.

    A filter of fixed size says which are wanted; what it lets through besides repeats or holds nothing that counts.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield counter_rows(_known(*(batch[c].to_numpy() for c in ("anchor", "seg", "doc_id", "start"))))

    known = docs.sparkSession.sparkContext.broadcast(bitmap(merged(wanted.select("anchor", "seg", "doc_id", "start").mapInArrow(bits, COUNTERS), 1, FILTER), FILTER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, at, raw in _batches(batches, "text"):
            anchor, seg, text, first, end = _segments(batch, data, at, shared.value, powers)
            some = bit_of(known.value, _known(anchor, seg, batch["doc_id"].to_numpy()[text], first - at[text]))
            yield _rows(batch, raw, at, *(v[some] for v in (anchor, seg, text, first, end)))

    return docs.mapInArrow(run, SEGMENTS)


def _dealt_again(rows: DataFrame, anchor: int) -> DataFrame:
    """Segments of segments, by anchors of so many bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, at, raw in _batches(batches, "data"):
            own, text, first, last = anchors(data, at, anchor)
            yield _rows(batch, raw, at, own, _hash(data, first, last + WINDOW, powers), text, first, last + WINDOW)

    return rows.mapInArrow(run, SEGMENTS)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a shard of every SHARD bytes, about, without parting an anchor."""
    held, total = [], 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("anchor", "doc_id", "text_key", "start", "data")), strict=True):
            if total >= SHARD and row[0] != held[-1][0]:
                yield _shard(held)
                held, total = [], 0
            held.append(row)
            total += len(row[4]) + 1
    if held:
        yield _shard(held)


def _shard(held: list[tuple]) -> pa.RecordBatch:
    """doc_id, text_key, start and n of what another place has that is earlier."""
    text, at = induced.joined([row[4] for row in held])
    _, doc, key, start = (np.array([row[i] for row in held], np.int64) for i in range(4))
    gone = []
    for pos, common in induced.sort(text, len(held), WINDOW):
        group = np.cumsum(common < WINDOW)
        some = np.append(common[1:] >= WINDOW, False) | (common >= WINDOW)
        pos, group = pos[some], group[some]
        part = np.searchsorted(at, pos, side="right") - 1
        place = pos - at[part] + start[part]
        order = np.lexsort((place, key[part], doc[part], group))
        gone.append(pos[order][np.append(False, group[order][1:] == group[order][:-1])[: len(order)]])
    pos = np.sort(np.concatenate([*gone, np.zeros(0, np.int64)]).astype(np.int64))
    part = np.searchsorted(at, pos, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(pos) > 1) | (np.diff(part) > 0)])[: len(pos)])
    last = np.append(first[1:], len(pos))[: len(first)] - 1
    own = part[first]
    return pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(key[own]), pa.array(pos[first] - at[own] + start[own]), pa.array(pos[last] - pos[first] + WINDOW)], ["doc_id", "text_key", "start", "n"])


def _decided(rows: DataFrame, level: int, group: int, spell: Callable | None = None) -> DataFrame:
    """(doc_id, text_key, start, n) of bytes that some earlier place has, from a written table of segments.

    Their bytes are in the table, or `spell` finds those of wanted ones.
    """
    place = ["doc_id", "text_key", "start"]
    content = [] if spell else ["data"]
    least = rows.groupBy("anchor", "seg").agg(F.min(F.struct(*place, "n", *content)).alias("m")).select("anchor", "seg", "m.*")
    least = stored(least, "distinct-segments")
    firsts = least.select("anchor", "seg", F.struct(*place).alias("first"))
    out = rows.select("anchor", "seg", *place, "n").join(firsts, ["anchor", "seg"]).filter(F.struct(*place) != F.col("first")).select(*place, "n")
    counts = stored(least.groupBy("anchor").agg(F.count("*").alias("segs")).filter("segs > 1"), "shared-anchors")
    if spell:
        least = stored(spell(least.join(counts, "anchor")), "spelled")
    several = least.join(counts, "anchor")
    few = several if level + 1 == len(ANCHORS) else several.filter(F.col("segs") <= group)  # anchors as long as a window have one segment
    out = out.union(few.select("anchor", *place, "data").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search, "doc_id bigint, text_key bigint, start bigint, n bigint"))
    common = counts.filter(F.col("segs") > group)
    if level + 1 == len(ANCHORS) or common.isEmpty():
        return out
    many = several.filter(F.col("segs") > group).select(*place, "data")
    return out.union(_decided(stored(_dealt_again(many, ANCHORS[level + 1]), "segments-again"), level + 1, group))


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, text_key, spans) of documents with repeated bytes; spans (start, n) are in no order and may overlap.

    docs has doc_id, text and text_key (a hash of the text, for ids that are repeated), none of them null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_shared_anchors(docs))
    rows = stored(_find(docs, shared), "segments")
    own = rows.filter("anchor is null").select("doc_id", "text_key", "start", "n")
    found = stored(own.union(_decided(rows.filter("anchor is not null"), 0, group, lambda wanted: _spelled(docs, shared, wanted))), "repeated-bytes")
    return found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))  # of one document


def deduplicate(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs.

    Texts are UTF-8 bytes. A byte goes if a string of WINDOW bytes that covers it also starts earlier: in a document with a
    smaller doc_id, or in the same one further to the left; strings are judged on the input and may overlap. n_spans counts
    the maximal runs of bytes that go; the digest is of those that stay, joined.

    A null text is empty; texts shorter than a window keep all. Very long texts are read whole. Rows with a null doc_id
    keep all and repeat nothing. Rows equal in id and text are one document, and each gives its row; of different texts
    under one id that with the smaller hash counts as the earlier. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data = (text or "").encode()
                if not spans:
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                delta = np.zeros(len(data) + 1, np.int32)
                a = np.array([s["start"] for s in spans])
                np.add.at(delta, a, 1)
                np.add.at(delta, a + np.array([s["n"] for s in spans]), -1)
                gone = np.cumsum(delta[:-1]) > 0
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
            columns = list(map(list, zip(*out, strict=True))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = repeats(own.filter("doc_id is not null and text is not null"), group)
    marked = own.join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return marked.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
