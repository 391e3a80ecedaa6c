"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import reliable as cut
from ..storage import shared_dir

#: Text held at once by a Python stage, in characters; bounds a worker's memory whatever the batch size.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, docs: DataFrame, *taken: str) -> str:
    """name, with underscores behind it until docs has no such column (names differ by more than case) and it isn't taken."""
    used = {c.lower() for c in (*docs.columns, *taken)}
    while name.lower() in used:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back: columnar, compressed and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(parts: Iterator[DataFrame], n: int, name: str) -> DataFrame:
    """The rows of n tables of one schema; more than one are written to the shared folder in turn, so that no plan holds them all."""
    first = next(parts)
    if n == 1:
        return first
    spark = first.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    first.write.parquet(path)
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(first.schema).parquet(path)


def chunks(lengths: Iterable[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive items with at most `limit` characters together, or one item that alone is longer."""
    start, held, n = 0, 0, 0
    for n, size in enumerate(lengths, 1):
        if held and held + size > limit:
            yield start, n - 1
            start, held = n - 1, 0
        held += size
    if n > start:
        yield start, n


def offsets(lengths) -> np.ndarray:
    """Starts of consecutive runs of these lengths, and the end of the last."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]] along the last axis; empty runs give 0."""
    total = np.zeros((*values.shape[:-1], values.shape[-1] + 1), dtype=np.float64)
    np.cumsum(values, axis=-1, dtype=np.float64, out=total[..., 1:])
    return total[..., starts[1:]] - total[..., starts[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (multiply and shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def id_crc(column: str = "doc_id"):
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))


def read_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """A vocabulary file of bounded size, read on the driver so that workers get it by broadcast."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} holds more than {limit} bytes")
    return data
