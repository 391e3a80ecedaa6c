"""Operator 7: token counts without token ids.

Pieces are counted once for each distinct pre-token, and joined to how often each document has that pre-token. The
join runs inside each block of documents, on dictionary codes: both of its sides arise there, so nothing is shuffled,
no pre-token (however common) gathers in one task, and what a worker keeps between blocks is a bounded memo.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import chunks, read_bytes

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Distinct pre-tokens whose piece counts a worker keeps.
MEMO = 600_000
#: No memo for pre-tokens longer than this.
MEMO_BYTES = 64


class PieceCounter:
    """Piece counts by a tokenizers file, for whole texts, by way of distinct pre-tokens."""

    def __init__(self, data: bytes, classes: np.ndarray):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.classes, self.memo = Tokenizer.from_str(data.decode()), classes, {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def of_pieces(self, distinct: list[bytes]) -> np.ndarray:
        """Pieces of each distinct pre-token."""
        new = [x for x in distinct if x not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = distinct
        counts = map(len, self.tokenizer.encode_batch([x.decode() for x in new], add_special_tokens=False))
        fresh = dict(zip(new, counts, strict=True))
        known = self.memo
        out = np.fromiter((fresh[x] if x in fresh else known[x] for x in distinct), np.int64, len(distinct))
        self.memo.update((k, v) for k, v in fresh.items() if len(k) <= MEMO_BYTES)
        return out

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        extra, parts, owner = np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):  # special strings are found first, and count one token each
            own = [text]
            for special in self.special:
                if special in text:
                    own = [y for x in own for y in x.split(special)]
                    extra[i] += text.count(special)
            parts += own
            owner += [i] * len(own)
        data, begin, end, per_part = pretokens.pieces(parts, self.classes)
        codes, distinct = pd.factorize(np.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)] or [b""], object)[: len(begin)])
        if not len(codes):
            return extra
        document = np.repeat(np.array(owner, np.int64), per_part)
        pairs, often = np.unique(document * len(distinct) + codes, return_counts=True)  # frequencies by document and pre-token
        tokens = often * self.of_pieces(list(distinct))[pairs % len(distinct)]  # the join, on codes
        return extra + np.bincount(pairs // len(distinct), weights=tokens, minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row of docs.

    Whole texts count, as the tokenizers library encodes them without begin and end tokens; a special token's string
    inside a text is one token, as is the library's default. A null text is empty: 0 bytes, 0 tokens. Rows with a null
    or repeated doc_id each give a row. An empty table gives no rows. Other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    file, classes = context.broadcast(read_bytes(tokenizer_path)), context.broadcast(pretokens.class_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(file.value, classes.value)
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            ids = batch["doc_id"]
            for a, b in chunks(map(len, texts)):
                part = texts[a:b]
                n = counter.of_texts(part)
                size = [len(x.encode()) for x in part]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
