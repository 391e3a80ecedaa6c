"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Training is one pass that counts (language, bucket) pairs in each partition before a grouped sum, so no text and no
language gathers anywhere. The log-probability matrix has languages x buckets entries; the number of buckets is chosen
so that it stays under MATRIX_BYTES whatever the number of languages, which bounds the broadcast. Scoring adds up
matrix columns for all n-grams of a block of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_crc, offsets, segment_sums

ORDERS = (1, 2, 3)
MAX_BUCKETS = 1 << 15
MATRIX_BYTES = 64 << 20
#: Characters hashed at a time.
SPAN = 1 << 18
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    log_probability: np.ndarray  # languages x buckets
    prior: np.ndarray


def ngrams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all lower-cased texts, and for each text and order where its run starts: text after text."""
    bits = np.uint64(64 - buckets.bit_length() + 1)
    points = np.frombuffer("".join(t.lower() for t in texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    at = offsets([len(t.lower()) for t in texts])
    out, lengths = [], []
    for order in ORDERS:
        h = np.full(max(0, len(points) - order + 1), order, np.uint64)
        for j in range(order):
            h = (h * np.uint64(0x100000001B3)) ^ points[j : j + len(h)]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> bits
        sizes = np.maximum(np.diff(at) - order + 1, 0)
        inside = np.ones(len(h), bool)
        for back in range(1, order):  # n-grams that reach into the next text
            ends = at[1:-1] - back
            inside[ends[(ends >= 0) & (ends < len(h))]] = False
        out.append(h[inside].astype(np.int32))
        lengths.append(sizes)
    return out, lengths


def _counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over docs, with bucket -1 for the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                own = held.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own[-1] += len(texts)
                for a, b in chunks(map(len, texts), SPAN):
                    for h in ngrams(texts[a:b], buckets)[0]:
                        own[:-1] += np.bincount(h, minlength=buckets)
            if len(held) * buckets * 8 > MATRIX_BYTES:
                yield from _rows(held)
        yield from _rows(held)

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _rows(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, own in held.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == len(own) - 1, -1, at), pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])
    held.clear()


def train(docs: DataFrame, learn: Column) -> Model:
    """A model from the rows of docs (text, lang) where `learn` holds and neither text nor lang is null.

    The matrix has MAX_BUCKETS buckets for up to 512 languages; with more it has half as many for each doubling, so that
    n-grams share buckets and accuracy falls. More than 65536 different names raise a ValueError: the matrix would
    outgrow MATRIX_BYTES.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MATRIX_BYTES // 1024 + 1).collect())
    if len(languages) * 1024 > MATRIX_BYTES:
        raise ValueError("more languages than the matrix has room for")
    buckets = MAX_BUCKETS
    while buckets > 256 and buckets * len(languages) * 4 > MATRIX_BYTES:
        buckets //= 2
    found = _counts(rows, buckets).toArrow() if languages else None
    n, documents = np.zeros((len(languages), buckets)), np.zeros(len(languages))
    if languages:
        row = np.searchsorted(languages, found["lang"].to_pylist())
        bucket, count = found["bucket"].to_numpy(), found["n"].to_numpy()
        total = bucket < 0
        n[row[~total], bucket[~total]] = count[~total]
        documents[row[total]] = count[total]
    n += 0.1  # smoothing
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32), np.log(np.maximum(documents, 1) / max(documents.sum(), 1)))


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language of each text (ties: first by name) and its posterior probability."""
    total = np.tile(model.prior[:, None], (1, len(texts)))
    for a, b in chunks(map(len, texts), SPAN):
        for h, sizes in zip(*ngrams(texts[a:b], model.log_probability.shape[1]), strict=True):
            at = offsets(sizes)
            for k, row in enumerate(model.log_probability):
                total[k, a:b] += segment_sums(row[h], at)
    best = total.argmax(axis=0)
    return best, 1 / np.exp(total - total.max(axis=0)).sum(axis=0)


def predict(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch in batches:
            texts, letters = [x or "" for x in batch["text"].to_pylist()], batch["letters"].to_pylist()
            if known.languages:
                best, sure = score(known, texts)
                name = [known.languages[i] if has else UNKNOWN for i, has in zip(best.tolist(), letters, strict=True)]
            else:
                name, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(name, pa.string()), pa.array(np.where(letters, sure, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, schema)


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predicts the language of each row of docs from its text, with a model of the rows outside the held-out fold.

    The fold of a document is crc32(doc_id as text) mod `folds`; rows with a null doc_id, text or lang teach nothing.
    Output has one row for each input row: doc_id, held_out (false for a null doc_id), lang_pred (`und`, score 0, if
    the text is null or has no letter, or if no row could be learned from) and score, the posterior probability. Ties
    go to the name that sorts first. An empty table gives no rows. Other columns are not read.
    Very long texts are scored whole, a text beyond a block's size in a block of its own.
    """
    fold = F.pmod(id_crc(), F.lit(folds)) == held
    return predict(docs, train(docs, ~fold), fold)
