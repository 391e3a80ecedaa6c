"""Operator 13: how five text filters interact, in all their orders.

Words are exploded and aggregated by text and word, then by text, for totals and distinct words; texts stand for all rows
that have them, so that copies are counted once and no key gathers them. The other flags are joined from outside. Rows are
then counted by part in 32 conditional columns, one for each set of failed filters (and 32 each for good and toxic rows);
all orders and steps are sums of these columns.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SPACES = "[\\x20\\x09-\\x0D]+"
#: Orders of the filters, for the sum over all of them.
N_ORDERS = 120


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, part, text and 128 bits of hashes of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("second"), "text")})


def word_totals(rows: DataFrame) -> DataFrame:
    """k1, k2, n_words and n_distinct of each distinct text with words; rows has k1, k2 and text.

    Texts are shuffled once, after equal ones met in their own partition. Both aggregations below go on in the tasks
    that read them, as (k1, k2) deals out (k1, k2, word) too.
    """
    words = rows.groupBy("k1", "k2").agg(F.first("text").alias("text")).select("k1", "k2", F.explode(F.split("text", SPACES)).alias("word"))
    by_word = words.filter(F.col("word") != "").groupBy("k1", "k2", "word").agg(F.count("*").alias("n"))
    return by_word.groupBy("k1", "k2").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and failed (bits 0 to 4 for A to E) of each row of docs."""
    rows = _keyed(docs)
    flags = rows.select("k1", "k2", "doc_id", (F.regexp_count("text", F.lit("[A-Z]")) * 100 > F.length("text") * 2).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"))
    other = flags.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("c").alias("c"), F.max("d").alias("d"))
    both = other.join(word_totals(rows), ["k1", "k2"], "left")
    total, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    bits = (total < 200).cast("int") + (distinct * 100 < total * 50).cast("int") * 2 + F.col("c").cast("int") * 4 + F.col("d").cast("int") * 8
    by_text = stored(both.select("k1", "k2", "first", bits.alias("bits")), "filter-flags")  # so that the join starts from two shuffles, whose hot texts can be split
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return rows.drop("text").join(by_text, ["k1", "k2"]).select("doc_id", "part", (F.col("bits") + copy * 16).alias("failed"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part and, for each set of failed filters, the number of rows, of good and of toxic ones: n0 to n31, good0.., toxic0.."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("doc_id is not null")
    own = stored(own.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")), "filter-labels")
    rows = failures(docs).join(own, "doc_id", "left")
    columns = []
    for m in range(MASKS):
        here = F.col("failed") == m
        columns += [F.count_if(here).alias(f"n{m}"), F.count_if(here & F.col("good")).alias(f"good{m}"), F.count_if(here & F.col("toxic")).alias(f"toxic{m}")]
    return rows.groupBy("part").agg(*columns)


def _steps() -> Column:
    """All (filter_order, step, before, own): bits of the filters applied before a step, and of the step's own."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(bit[f]).alias("own")))
            before |= bit[f]
    return F.array(*out)


def _sum(prefix: str, wanted) -> Column:
    """The sum of the columns whose number wanted takes, from an array of all of them."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("bigint"), lambda total, m: total + F.when(wanted(m), F.get(prefix, m)).otherwise(F.lit(0).cast("bigint")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step: what the step keeps, removes and would have removed.

    part is the source (null: empty string). Filters fail rows: A under 200 words; B distinct words below half of all; C
    more than 2 % of code points in A-Z; D any of # $ % & * |; E the text of a smaller doc_id, table-wide. Counted are
    rows: kept, removed, redundant (failing, but removed before), unique_fails (failing nothing else), good_lost and
    toxic_lost (removed rows with that label), shapley (removed by the filter, summed over all orders).

    A null text is empty: no words, so that A fails alone. Very long texts are read whole; words are rows of an
    aggregation that can spill. Rows with a null doc_id are no copies of any and make none; rows with equal ids are no
    copies of each other; each repeated row counts. Labels of a repeated id hold if one of its rows has them; a null label
    doesn't. An empty table has no parts and gives no rows. Other columns are not read.
    """
    arrays = [F.array(*[F.col(f"{p}{m}") for m in range(MASKS)]).alias(p) for p in ("n", "good", "toxic")]
    rows = counts(docs, labels).select("part", *arrays).withColumn("s", F.explode(_steps())).select("part", "n", "good", "toxic", "s.*")
    before, own = F.col("before"), F.col("own")

    def lost(m):
        return (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)

    share = F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("bigint"), lambda total, m: total + F.when(m.bitwiseAND(own) != 0, (F.get("n", m) * F.lit(N_ORDERS) / F.bit_count(m)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return rows.select(
        "part",
        "filter_order",
        "step",
        _sum("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        _sum("n", lost).alias("removed"),
        _sum("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"),
        _sum("n", lambda m: m == own).alias("unique_fails"),
        _sum("good", lost).alias("good_lost"),
        _sum("toxic", lost).alias("toxic_lost"),
        share.alias("shapley"),
    )
