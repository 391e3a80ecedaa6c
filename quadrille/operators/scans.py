"""Running values over one order of any length, without a task that holds all of it.

Rows are dealt to ranges of the order, each sorted in a task of its own. A row then needs what its range has before it, a
window over the range, and what the ranges before have, a value for each range. Only the latter, a row for each
range, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import reliable

#: Columns that placed frames have: the range, and the place in it.
RANGE, PLACE = "_range", "_place"
_BITS = 33  # of a row's place, as Spark numbers rows of partitions


def placed(df: DataFrame, *order: str | Column) -> DataFrame:
    """df in ranges of the order, which should have no ties, as a range can't part them."""
    ranges = reliable(df.repartitionByRange(*order).sortWithinPartitions(*order))  # so that numbers of rows stay, whatever is run again
    row = ranges.withColumn(PLACE, F.monotonically_increasing_id())
    return row.withColumn(RANGE, F.call_function("shiftright", F.col(PLACE), F.lit(_BITS)))


def _with_carry(rows: DataFrame, totals: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(totals), RANGE)  # a row for each range of rows


def ranked(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """df with each row's place in the whole order, from 0."""
    rows = placed(df, *order)
    before = F.coalesce(F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = rows.groupBy(RANGE).agg(F.count("*").alias("n")).select(RANGE, before.alias("_first"))
    place = F.col(PLACE) - F.call_function("shiftleft", F.col(RANGE), F.lit(_BITS))
    return _with_carry(rows, first).withColumn(name, (F.col("_first") + place).cast("bigint")).drop("_first", RANGE, PLACE)


def running(rows: DataFrame, **values: tuple[str, Column, bool]) -> DataFrame:
    """A placed frame with running values: name=(kind, column, inclusive).

    kind is sum, max or last (the last that isn't null); a row's own value counts where it is inclusive. Nulls count
    nothing, and before all values a sum is 0, the others null.
    """
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    total = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(PLACE)))}
    ranges = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(RANGE).agg(*(total[kind](c).alias(f"_t_{n}") for n, (kind, c, _) in values.items()))
    totals = totals.select(RANGE, *(fold[kind](F.col(f"_t_{n}")).over(ranges).alias(f"_c_{n}") for n, (kind, _, _) in values.items()))
    out = _with_carry(rows, totals)
    for n, (kind, c, inclusive) in values.items():
        own = fold[kind](c).over(Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        carry = F.col(f"_c_{n}")
        both = {"sum": F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)), "max": F.greatest(own, carry), "last": F.coalesce(own, carry)}
        out = out.withColumn(n, both[kind])
    return out.drop(*(f"_c_{n}" for n in values))


def fill_runs(values: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Runs of equal values over positions in order, bridging unset (null) ones between equal ones.

    Null is the wildcard: nulls between two equal values belong to their run; nulls at a run's end don't.
    """
    rows = placed(values.filter(F.col(value).isNotNull()), *by, at)
    own = F.struct(*by, value)
    seen = running(rows, _before=("last", own, False))
    numbered = running(seen.withColumn("_new", F.when(F.col("_before").eqNullSafe(own), 0).otherwise(1)), _run=("sum", F.col("_new"), True))
    return numbered.groupBy(*by, "_run", value).agg(F.min(at).alias("start"), (F.max(at) - F.min(at) + 1).alias("length")).drop("_run")


def merge_intervals(df: DataFrame, by: list[str]) -> DataFrame:
    """Union of touching or overlapping intervals (s, e) of each group, groups of any size.

    The running maximum of (group, end) is the group's own as soon as the group has begun, as groups are in order.
    """
    rows = placed(df.select(*by, "s", "e"), *by, "s", "e")
    group = F.struct(*by)
    seen = running(rows, _before=("max", F.struct(group.alias("g"), F.col("e").alias("e")), False))
    opens = F.when(F.col("_before").isNull() | ~F.col("_before.g").eqNullSafe(group) | (F.col("s") > F.col("_before.e")), 1).otherwise(0)
    numbered = running(seen.withColumn("_new", opens), _island=("sum", F.col("_new"), True))
    return numbered.groupBy(*by, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def sweep_cost(df: DataFrame, by: list[str]) -> DataFrame:
    """Sum over intervals (s, e) of how many others of their group are open where they start.

    Groups lie one behind the other; as all that is opened in a group is closed in it, one running sum serves them all.
    """
    events = df.select(*by, F.col("s").alias("at"), F.lit(1).alias("open")).union(df.select(*by, F.col("e"), F.lit(-1)))
    # ends come before starts at one place
    active = running(placed(events, *by, "at", "open"), active=("sum", F.col("open"), False))
    return active.filter("open = 1").groupBy(*by).agg(F.sum("active").alias("cost"))
