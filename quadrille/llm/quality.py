"""Operator 5: a quality classifier of supervised subword embeddings.

Each word has a hashed vector of its own and vectors of its hashed character n-grams; a document is the average of all
of them, and a softmax layer on top gives the class. Vectors and layer are learned by stochastic gradient descent in
numpy, over a sample of labelled documents that SAMPLE bounds (the only bounded part). A repeated word (the same as
the one before) counts as a word of its own: the one word bigram in the vocabulary.

The score is linear in the average before the softmax, so for scoring the learned vectors are multiplied with the layer
once: what is broadcast is one number for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_crc, offsets, segment_sums

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (2, 3, 4)
#: Labelled documents that are learned from, at most: those with the smallest hashes of their ids.
SAMPLE = 5000
EPOCHS = 4
RATE = 0.4
SPAN = 1 << 19
REPEAT = BUCKETS - 1


def _word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words: the word's own, then those of the n-grams of <word>; and offsets by word."""
    marked = [f"<{w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    at = offsets([len(m) for m in marked])
    size = np.diff(at)
    # own hash of a word: sum of mixed characters and places
    place = np.arange(len(points), dtype=np.uint64) - np.repeat(at[:-1], size).astype(np.uint64)
    mixed = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * (place * np.uint64(2) + np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed, at[:-1]) if len(words) else np.zeros(0, np.uint64)
    parts, owners = [whole], [np.arange(len(words))]
    owner = np.repeat(np.arange(len(words)), size)
    for n in NGRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) ^ points[j : j + len(h)]
        inside = owner[: len(h)] == owner[n - 1 :]
        parts.append(h[inside] * np.uint64(0xC2B2AE3D27D4EB4F))
        owners.append(owner[: len(h)][inside])
    order = np.argsort(np.concatenate(owners), kind="stable")
    bucket = ((np.concatenate(parts)[order] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(REPEAT)
    return bucket.astype(np.int64), offsets(np.bincount(np.concatenate(owners), minlength=len(words)))


def _words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Code of each word, distinct words, offsets by text, and which words repeat the one before."""
    split = [t.split() for t in texts]
    at = offsets([len(s) for s in split])
    codes, distinct = pd.factorize(np.array([w for s in split for w in s] or [""], object)[: at[-1]])
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    starts = at[:-1]
    again[starts[starts < len(codes)]] = False
    return codes, list(distinct), at, again


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and how often it has them: views of two arrays of the narrowest types that fit, as a sample's are all held."""
    codes, distinct, at, again = _words(texts)
    bucket, by_word = _word_buckets(distinct)
    indexes, counts = [], []
    for i in range(len(texts)):
        own, often = np.unique(codes[at[i] : at[i + 1]], return_counts=True)
        features = np.concatenate([[REPEAT], *(bucket[by_word[w] : by_word[w + 1]] for w in own)]).astype(np.int64)
        times = np.concatenate([[again[at[i] : at[i + 1]].sum()], np.repeat(often, by_word[own + 1] - by_word[own])])
        index, inverse = np.unique(features, return_inverse=True)
        indexes.append(index.astype(np.int32))
        counts.append(np.bincount(inverse, weights=times).astype(np.int64))
    ends = offsets([len(x) for x in indexes])
    index, count = np.concatenate(indexes), np.concatenate(counts)
    count = count.astype(np.min_scalar_type(count.max()))
    return [(index[a:b], count[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Classifier:
    """Two classes; learned vectors and softmax layer."""

    def __init__(self, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
        self.layer, self.bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)

    def fit(self, texts: list[str], labels: np.ndarray) -> None:
        documents = []
        for a, b in chunks(map(len, texts), SPAN):
            documents += _features(texts[a:b])
        steps, total = 0, EPOCHS * len(texts)
        for _ in range(EPOCHS):
            for i in self.rng.permutation(len(texts)):
                rate, steps = RATE * (1 - steps / total), steps + 1
                index, weight = documents[i]
                weight = (weight / max(int(weight.sum()), 1)).astype(np.float32)
                mean = weight @ self.vectors[index]
                logits = self.layer @ mean + self.bias
                p = np.exp(logits - logits.max())
                error = (p / p.sum()).astype(np.float32)
                error[labels[i]] -= 1
                back = error @ self.layer
                self.layer -= rate * np.outer(error, mean)
                self.bias -= rate * error
                # a document's average spreads over thousands of vectors: weights relative to the largest keep steps alive
                self.vectors[index] -= np.outer(rate * weight / max(weight.max(), 1e-9), back).astype(np.float32)

    def collapsed(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the two logits, and the difference without features."""
        return self.vectors @ (self.layer[1] - self.layer[0]), float(self.bias[1] - self.bias[0])


def score(model: tuple[np.ndarray, float], texts: list[str]) -> np.ndarray:
    """Probability of class 1 of each text."""
    weight, bias = model
    out = np.zeros(len(texts))
    for a, b in chunks(map(len, texts), SPAN):
        codes, distinct, at, again = _words(texts[a:b])
        bucket, by_word = _word_buckets(distinct)
        value, count = segment_sums(weight[bucket], by_word), np.diff(by_word)
        repeats = segment_sums(again.astype(np.float64), at)
        total = segment_sums(value[codes] if len(codes) else np.zeros(0), at) + repeats * weight[REPEAT]
        number = segment_sums(count[codes].astype(np.float64) if len(codes) else np.zeros(0), at) + repeats
        out[a:b] = total / np.maximum(number, 1)
    return 1 / (1 + np.exp(-np.clip(out + bias, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The collapsed model from at most `sample` labelled rows where `learn` (over doc_id) holds.

    Conflicting labels of one id count as its least; an id with several rows of text gives the least of them. Without
    any labelled row each text scores 0.5.
    """
    marked = labels.filter(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # `sample` rows at most are broadcast
    found = rows.toArrow().sort_by("doc_id")
    model = Classifier()
    if found.num_rows:
        model.fit([x or "" for x in found["text"].to_pylist()], found["quality"].to_numpy().astype(int))
    return model.collapsed()


def scorer(docs: DataFrame, model: tuple[np.ndarray, float]):
    """A vectorised column function from text to score; null text scores as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(score(shared.value, [x or "" for x in part]))

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score (of quality 1) and predicted (score >= threshold) of each row of docs.

    Only labels of rows outside the held-out fold, crc32(doc_id as text) mod `folds`, are learned from. Texts are used
    whole; a null text scores as an empty one, which has the score of no features. A null doc_id is never held out.
    Repeated rows each give a row; an empty table gives none. Other columns are not read.
    """
    fold = F.pmod(id_crc(), F.lit(folds)) == held
    score_of = scorer(docs, train(docs, labels, ~fold))
    scored = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold, F.lit(False)).alias("held_out"), score_of(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
