"""Counters of a fixed number of buckets or of 64-bit hashes, added up in blocks, and those that reach a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import stored

#: Counters that one row spans, as a power of two.
BLOCK = 16
COUNTERS = "block int, low binary, n binary"
#: Blocks of hashes, as a power of two, and counters of one block that are added up at once.
HASH_BLOCKS = 12
SUMMED = 1 << 20


def bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def bitmap(rows: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits on the driver from (block, bits) rows, one for each block with a bit set.

    The rows are written first: read one by one from the tasks that make them, these tasks would run one after the other.
    """
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << BLOCK) // 8
    for row in stored(rows, "bits").toLocalIterator():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def merged(rows: DataFrame, least: int, bits: int) -> DataFrame:
    """(block, bits): which counters of each block reach `least`; counters are added while rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, low, n in zip(batch["block"].to_pylist(), batch["low"].to_pylist(), batch["n"].to_pylist(), strict=True):
                counters = sums.setdefault(block, np.zeros(1 << BLOCK, np.int64))
                counters[np.frombuffer(low, np.uint16)] += np.frombuffer(n, np.uint32)
        found = {b: np.packbits(c >= least, bitorder="little").tobytes() for b, c in sums.items() if c.max() >= least}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())], ["block", "bits"])

    return rows.repartition(max(1, 1 << (bits - BLOCK - 6)), "block").mapInArrow(run, "block int, bits binary")


def counter_rows(buckets: np.ndarray, bits: int | None = None) -> pa.RecordBatch:
    """Counters of these buckets, a row for each block (of 2^bits or 2^BLOCK) that has any: low bits and counts, sorted."""
    bits = BLOCK if bits is None else bits
    at, n = np.unique(buckets, return_counts=True)
    return _rows(at >> bits, (at & ((1 << bits) - 1)).astype(np.uint16), n)


def hash_rows(hashes: np.ndarray) -> pa.RecordBatch:
    """Counters of these hashes, a row for each block of them that has any; low is the whole hash."""
    at, n = np.unique(hashes, return_counts=True)
    return _rows((at >> np.uint64(64 - HASH_BLOCKS)).astype(np.int32), at, n)


def _rows(block: np.ndarray, low: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    ends = np.append(start, len(block))

    def packed(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    return pa.RecordBatch.from_arrays([pa.array(block[start], pa.int32()), packed(low), packed(n.astype(np.uint32))], ["block", "low", "n"])


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(hashes, kind="stable")
    hashes, n = hashes[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[start], np.add.reduceat(n, start)


def hash_sums(rows: DataFrame, least: int) -> DataFrame:
    """(hash, n) of the hashes whose counters reach `least` together; one block is added up at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, limit = None, [], 0, SUMMED

        def out():
            hashes, n = _summed(held)
            ok = n >= least
            return pa.RecordBatch.from_arrays([pa.array(hashes[ok].view(np.int64)), pa.array(n[ok])], ["hash", "n"])

        for batch in batches:
            for block, low, n in zip(*(batch[c].to_pylist() for c in ("block", "low", "n")), strict=True):
                if block != own:
                    if held:
                        yield out()
                    own, held, size, limit = block, [], 0, SUMMED
                held.append((np.frombuffer(low, np.uint64), np.frombuffer(n, np.uint32).astype(np.int64)))
                size += len(low) // 8
                if size > limit:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    limit = max(SUMMED, 2 * size)
        if held:
            yield out()

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "hash bigint, n bigint")
