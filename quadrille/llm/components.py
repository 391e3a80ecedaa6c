"""Connected components of links between integer ids, by alternating star contractions.

Each round is two grouped minima and joins; links never gather on the driver or in one task. The number of rounds grows
with the logarithm of the number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _hooked(links: DataFrame, upward: bool) -> DataFrame:
    """Each larger (upward) or smaller neighbour of u, and u itself, is linked to the least of u's neighbourhood."""
    both = links.union(links.select("b", "a").toDF("a", "b")) if upward else links.select("b", "a").toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    rows = both.join(least, "a")
    if upward:
        out = rows.filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = rows.select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the least id that can be reached.

    Loops a = b, repeated and reversed links and null ends are allowed; no links give no rows.
    """
    links = cut(links.filter("a <> b").select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).distinct())
    state = None
    while True:
        links = cut(_hooked(_hooked(links, True), False))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
    return links.select(F.col("b").alias("id"), F.col("a").alias("component")).union(links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
