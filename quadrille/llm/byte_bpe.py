"""Operator 9: byte-level byte-pair encoding and decoding.

Boundaries of pre-tokens come from `pretokens` (class arrays and an associative scan). Slices of the UTF-8 go through
pair merging, once for each distinct slice that a bounded memo holds. Byte offsets of the vocabulary, and of the tokens
in each text, are kept: decoding copies byte ranges by those offsets and needs no dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import chunks, offsets, read_bytes

DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
MEMO = 600_000
MEMO_BYTES = 64


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the adjacent pair of least rank is joined, leftmost first, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return _merge_short(piece, ranks) if len(piece) <= 96 else _merge_long(piece, ranks)


NEVER = 1 << 60


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By looking over all pairs for each join."""
    rank = ranks.get
    at = list(range(len(piece) + 1))
    pair = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pair and (least := min(pair)) < NEVER:
        i = pair.index(least)
        del at[i + 1], pair[i]
        if i < len(pair):
            pair[i] = rank(piece[at[i] : at[i + 2]], NEVER)
        if i:
            pair[i - 1] = rank(piece[at[i - 1] : at[i + 1]], NEVER)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """By a heap of pairs, for pieces whose square is too much."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each byte; 0: no part starts there
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # one of the two has been joined to something else meanwhile
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, data: bytes, classes: np.ndarray):
        self.ranks, self.classes = parse_ranks(data), classes
        self.memo: dict[bytes, bytes] = {}
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        length = np.zeros(by_rank[-1][1] + 2, np.int64)
        for token, rank in by_rank:
            length[rank] = len(token)
        self.length = length
        self.start = np.cumsum(length) - length
        self.blob = np.frombuffer(b"".join(t for t, _ in by_rank), np.uint8)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        data, begin, end, per_text = pretokens.pieces(texts, self.classes)
        memo, out = self.memo, []
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            piece = data[a:b]
            ids = memo.get(piece)
            if ids is None:
                ids = np.array(merge(piece, self.ranks), "<u4").tobytes()
                if len(piece) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        at = offsets(per_text).tolist()
        return [b"".join(out[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def token_offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset in the text at which each token starts, and the text's length."""
        return offsets(self.length[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, copied from the vocabulary by offsets."""
        tokens = np.frombuffer(ids, "<u4")
        out = []
        for i in range(0, len(tokens), 1 << 16):  # long texts in bounded steps
            part = tokens[i : i + (1 << 16)]
            to = offsets(self.length[part])
            source = np.repeat(self.start[part] - to[:-1], self.length[part]) + np.arange(to[-1])
            out.append(self.blob[source].tobytes())
        return b"".join(out)


def _per_text(docs: DataFrame, ranks_path: str, schema: str, row) -> DataFrame:
    context = docs.sparkSession.sparkContext
    file, classes = context.broadcast(read_bytes(ranks_path)), context.broadcast(pretokens.class_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file.value, classes.value)
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            for a, b in chunks(map(len, texts)):
                columns = zip(*(row(codec, x) for x in codec.encode(texts[a:b])), strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], *(pa.array(list(c), k) for c, k in zip(columns, row.kinds, strict=True))], row.names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _ids(codec: Codec, ids: bytes) -> tuple:
    return np.frombuffer(ids, "<u4").astype(np.int64), codec.token_offsets(ids)[:-1], codec.decode(ids)


_ids.names, _ids.kinds = ["doc_id", "ids", "byte_offsets", "decoded"], [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def _digests(codec: Codec, ids: bytes) -> tuple:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


_digests.names, _digests.kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids, byte_offsets (where each token starts in the UTF-8) and decoded (bytes) of each row of docs.

    A null or empty text has no ids and decodes to nothing. Special tokens' strings are ordinary text. Each row of docs
    gives one row, also with null or repeated doc_id; an empty table gives none. Other columns are not read.
    """
    return _per_text(docs, ranks_path, "doc_id bigint, ids array<bigint>, byte_offsets array<bigint>, decoded binary", _ids)


def encode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """As encode(), with digests of ids (little-endian unsigned 32-bit) and of decoded bytes in their place."""
    return _per_text(docs, ranks_path, DIGESTS, _digests)
