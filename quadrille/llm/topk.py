"""Operator 3: exact top-k search by tiled matrix products.

Queries go out in blocks of bounded size; every task multiplies its tiles of candidates with the block, selects the
best of each tile, each vec_id once, and merges it with the best so far. Per-query lists of all tasks are merged in a tree of FAN-way
window steps, so that the last step sees at most FAN lists for each query, however many tasks there were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, stored

#: Bytes of queries broadcast at once.
BLOCK_BYTES = 16 << 20
TILE = 4096
#: Queries multiplied with a tile at once.
ROWS = 512
FAN = 32
EXACT = 2.0**53


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q, the array of floor(1024 x) with x as double; rows with a null id, a null vector, or null or non-finite components are left out."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    return vectors.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 1024.0).cast("double")).alias("q"))


def _matrices(ids: np.ndarray, lists) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    at = lists.offsets.to_numpy()
    size, flat = np.diff(at), lists.values.to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield ids[rows], flat[at[rows][:, None] + np.arange(n)]


def _products(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond what a double holds exactly, in Python's integers, held to 64 bits."""
    bound = queries.shape[1] * np.abs(queries).max(initial=0) * np.abs(tile).max(initial=0)
    if bound < EXACT / (4 * TILE):
        return (queries @ tile.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in tile], object).reshape(tile.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(object)


def _best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, column, score) of the k best of each row; columns are in the order of ids; a query's own id is out."""
    n = scores.shape[1]
    if scores.dtype == object:
        rows = [sorted((j for j in range(n) if ids[j] != own[i]), key=lambda j, i=i: (-scores[i, j], ids[j]))[:k] for i in range(len(scores))]
        r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        c = np.array([j for x in rows for j in x], np.int64)
        return r, c, np.array([int(scores[i, j]) for i, j in zip(r, c, strict=True)], np.int64)
    key = scores * TILE - np.arange(n)  # distinct, in the order of score, then of id
    key[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
    take = min(k, n)
    column = np.argpartition(key, n - take, axis=1)[:, n - take :]
    row = np.repeat(np.arange(len(scores)), take)
    column = column.reshape(-1)
    keep = own[row] != ids[column]
    return row[keep], column[keep], scores[row[keep], column[keep]]


def _merge(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each query row, each with its best score."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[once], ids[once], score[once]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return query[keep], ids[keep], score[keep]


def _search(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = block.value  # by length: (query numbers, ids, matrix)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            found = [held]
            for ids, matrix in _matrices(batch["vec_id"].to_numpy(), batch["q"]):
                if matrix.shape[1] not in groups:
                    continue
                number, own, queries = groups[matrix.shape[1]]
                order = np.argsort(ids, kind="stable")
                ids, matrix = ids[order], matrix[order]
                for t in range(0, len(ids), TILE):
                    start = np.flatnonzero(np.diff(ids[t : t + TILE], prepend=ids[t] - 1))  # an id's rows stand together
                    once = ids[t + start]
                    for i in range(0, len(own), ROWS):
                        scores = _products(queries[i : i + ROWS], matrix[t : t + TILE])
                        if len(once) < scores.shape[1]:
                            scores = np.maximum.reduceat(scores, start, axis=1)
                        row, column, score = _best(scores, own[i : i + ROWS], once, k)
                        found.append((number[i + row], once[column], score))
            held = _merge(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["query", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query, best first, ties to the smaller vec_id.

    Components are floor(1024 x), and so are at most 64-bit integers: larger ones are held to that. The score is the
    integer inner product, held to 64 bits as well where it would not fit.
    Candidates are all rows with another vec_id and a vector of the query's length. Rows with a null vec_id, a null vector, or null or
    non-finite components take no part; an empty vector scores 0 against empty ones. A vec_id that is repeated
    searches with its least vector and is found once, with its best score. Fewer candidates than k give fewer rows; an
    empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    per_query = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    blocks = max(1, -(-per_query[0] * (8 * per_query[1] + 64) // BLOCK_BYTES))
    if blocks > 1:  # or each block would make the queries anew
        queries = stored(queries, "queries")
    parts = rows.rdd.getNumPartitions()

    def found() -> Iterator[DataFrame]:
        for b in range(blocks):  # a block has BLOCK_BYTES, about: the hash deals ids evenly
            block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().sort_by("vec_id").combine_chunks()
            own = block["vec_id"].to_numpy()
            groups = {}
            if len(own):
                for ids, matrix in _matrices(own, block["q"].chunk(0)):
                    groups[matrix.shape[1]] = (ids, ids, matrix)
            # a query is in one block only: lists of equal numbers meet in any order
            yield rows.mapInArrow(_search(spark.sparkContext.broadcast(groups), k), "query bigint, vec_id bigint, score bigint").withColumn("part", F.spark_partition_id())

    out = gathered(found(), blocks, "top-lists")
    while parts > FAN:  # lists of FAN tasks become one
        parts = -(-parts // FAN)
        out = out.withColumn("part", F.pmod("part", F.lit(parts)))
        out = _ranked(out, ["query", "part"], k).drop("rank")
    return _ranked(out, ["query"], k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ranked(lists: DataFrame, by: list[str], k: int) -> DataFrame:
    once = lists.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
