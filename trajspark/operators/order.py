"""Places and running sums over a whole table, without a task that sees all of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch

#: Places of one bucket of a running sum.
PER_BUCKET = 100_000
_INSIDE = (1 << 33) - 1


def numbered(df: DataFrame, order: list[str | Column], out: str = "rank") -> DataFrame:
    """Gapless places from 1 in the order, which must tell rows apart for one result.

    Rows are dealt by ranges of the order and numbered where they lie; the
    numbered rows are written, and a partition's first place is the count of
    the partitions before it (a row for each partition).
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    written = scratch.materialize(dealt, "ordered").withColumn("__p", F.shiftright("__m", 33))
    counts = written.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__m").bitwiseAND(F.lit(_INSIDE)) + 1
    return written.join(F.broadcast(offsets), "__p").withColumn(out, place.cast("long")).drop("__m", "__p", "__before")  # a row for each partition


def numbered_within(df: DataFrame, group: list[str], order: list[str | Column], out: str = "rank") -> DataFrame:
    """Gapless places from 1 inside each group, however large: places over all groups less the group's first."""
    rows = numbered(df, [*group, *order], "__all")
    first = rows.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min("__all").alias("__first"))
    joined = rows.join(first, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]))
    return joined.select(*df.columns, (F.col("__all") - F.col("__first") + 1).alias(out))


def running_sum(df: DataFrame, place: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows with smaller places; places are longs without large gaps."""
    rows = df.withColumn("__b", F.expr(f"`{place}` div {PER_BUCKET}"))
    sums = rows.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))  # a row for each PER_BUCKET rows
    inside = Window.partitionBy("__b").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(offsets, "__b").withColumn(out, F.col("__own") + F.col("__before")).drop("__b", "__own", "__before")


def running_extreme(df: DataFrame, place: str, value: str, out: str, forwards: bool) -> DataFrame:
    """Greatest value over the rows up to each place, or least value over those from it on; nulls don't count."""
    best = F.max if forwards else F.min
    rows = df.withColumn("__b", F.expr(f"`{place}` div {PER_BUCKET}"))
    sums = rows.groupBy("__b").agg(best(value).alias("__s"))
    side = Window.orderBy(F.col("__b") if forwards else F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__b", best("__s").over(side).alias("__before"))  # a row for each PER_BUCKET rows
    inside = Window.partitionBy("__b").orderBy(F.col(place) if forwards else F.col(place).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("__own", best(value).over(inside)).join(offsets, "__b")
    either = F.array_max if forwards else F.array_min
    return own.withColumn(out, either(F.array("__own", "__before"))).drop("__b", "__own", "__before")


#: Distinct values up to which a group's quantiles are one aggregate of (value, count).
FEW_VALUES = 100_000


def group_quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of each group's non-null values.

    Rows become counts of distinct values before anything is ordered, so ties
    cost nothing.  While no group has more than ``FEW_VALUES`` of them they are
    one aggregate; beyond that, running counts over the order of all distinct
    values, found by ranges, tell which value holds a place.  Both are exact.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = scratch.materialize(counts, "values")
    most = counts.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= FEW_VALUES:
        return counts.groupBy(*group).agg(*[F.percentile("__v", F.lit(share), F.col("__n")).alias(name) for name, share in shares.items()])
    rows = running_sum(numbered(counts, [*group, "__v"], "__place"), "__place", "__n", "__until")
    totals = rows.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min("__until").alias("__first"), F.sum("__n").alias("__all"))
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group], F.lit(True))
    rows = rows.join(totals, on).withColumn("__from", F.col("__until") - F.col("__first"))
    aggregates = []
    for name, share in shares.items():
        at = (F.col("__all") - 1) * share
        low, part = F.floor(at), at - F.floor(at)
        holds = lambda k: (F.col("__from") <= k) & (k < F.col("__from") + F.col("__n"))
        high = F.least(low + 1, F.col("__all") - 1)
        share_of = F.when(holds(low), F.col("__v") * (1 - part)).otherwise(F.lit(0.0)) + F.when(holds(high), F.col("__v") * part).otherwise(F.lit(0.0))
        aggregates.append(F.sum(share_of).alias(name))
    return rows.groupBy(*group).agg(*aggregates)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], empty: float | None = None) -> DataFrame:
    """One row of exact, linearly interpolated quantiles of the non-null values (:func:`group_quantiles` of one group)."""
    found = group_quantiles(df.select(value), [], value, shares)
    return found if empty is None else found.fillna(empty)
