"""Audits that compute everything again from the raw rows and compare it with what was recorded.

A level is one table of records (sidecars, statistics, totals) with the
derivation that gives it anew.  All levels are compared by key and field, all
differences are kept, and a difference above is told apart from those that
follow from faults of the level below.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


class Level(NamedTuple):
    """Recorded and derived rows with the same key and fields; ``close`` has the relative tolerance of a field, others must be equal."""

    name: str
    recorded: DataFrame
    derived: DataFrame
    keys: list[str]
    fields: list[str]
    close: dict[str, float] = {}


def _differs(left: Column, right: Column, tolerance: float | None) -> Column:
    if tolerance is None:
        return ~left.eqNullSafe(right)
    a, b = left.cast("double"), right.cast("double")
    near = F.abs(a - b) <= F.greatest(F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    return ~F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near | a.eqNullSafe(b))


def differences(level: Level) -> DataFrame:
    """(level, key, field, derived): each field that differs, as text; ``missing`` and ``unknown`` for whole records."""
    r, d = (t.select(*level.keys, F.struct(*level.fields).alias(n)) for t, n in ((level.recorded, "r"), (level.derived, "d")))
    on = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in level.keys])
    both = r.alias("r").join(d.alias("d"), on, "full_outer")
    entry = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("derived"))
    whole = F.when(F.col("r.r").isNull(), F.array(entry("missing", F.lit(None)))).when(F.col("d.d").isNull(), F.array(entry("unknown", F.lit(None))))
    parts = F.array_compact(F.array(*[
        F.when(_differs(F.col(f"r.r.{f}"), F.col(f"d.d.{f}"), level.close.get(f)), entry(f, F.col(f"d.d.{f}"))) for f in level.fields]))
    key = F.concat_ws(":", *[F.coalesce(F.col(f"r.{k}"), F.col(f"d.{k}")).cast("string") for k in level.keys])
    return both.select(F.lit(level.name).alias("level"), key.alias("key"), F.explode(F.coalesce(whole, parts)).alias("e")).select("level", "key", "e.*")


def audit(levels: list[Level]) -> DataFrame:
    """All differences of all levels."""
    return reduce(DataFrame.unionByName, [differences(x) for x in levels])


def verdict(found: DataFrame, levels: list[str]) -> DataFrame:
    """(level, errors, passed, below): errors of each level in the order given, and of all levels below it."""
    spark = found.sparkSession
    names = spark.createDataFrame(list(enumerate(levels)), "place int, level string")
    counts = names.join(found.groupBy("level").agg(F.count(F.lit(1)).alias("errors")), "level", "left").fillna(0, ["errors"])
    below = counts.select(F.col("place").alias("__p"), F.col("errors").alias("__e"))
    lower = counts.join(below, F.col("__p") < F.col("place"), "left").groupBy("level", "errors")  # a few levels
    return lower.agg(F.coalesce(F.sum("__e"), F.lit(0)).cast("long").alias("below")).withColumn("passed", F.col("errors") == 0)


def checksum(*parts: str | Column) -> Column:
    """Order-independent digest of rows as an aggregate: the sum of 32-bit prefixes of their MD5, in partial sums."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.sum(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"))


def sidecars(raw: DataFrame, key: str, values: list[str], digest: list[str | Column]) -> DataFrame:
    """Each episode's record again from its rows: how many, their checksum, and its values' extremes."""
    ends = [a for v in values for a in (F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))]
    return raw.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), checksum(*digest).alias("checksum"), *ends)


def statistics(raw: DataFrame, values: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(channel, n, mean, std, low, high) of each value column over its finite values, non-finite ones counted."""
    entries = F.explode(F.array(*[F.struct(F.lit(v).alias("channel"), F.col(v).cast("double").alias("x")) for v in values]))
    rows = raw.select(entries.alias("e")).select("e.*")
    good = ~F.isnan("x") & (F.abs("x") < float("inf"))
    sums = rows.groupBy("channel").agg(
        F.count_if(good).alias("n"), F.avg(F.when(good, F.col("x"))).alias("mean"), F.stddev_pop(F.when(good, F.col("x"))).alias("std"),
        F.count_if(F.coalesce(~good, F.lit(True))).alias("not_finite"))
    return sums.join(order.group_quantiles(rows.filter(good), ["channel"], "x", {"low": low, "high": high}), "channel", "left")


def roll_up(records: DataFrame, rows: str = "rows") -> DataFrame:
    """Totals of the level below: (name, value)."""
    one = records.agg(F.count(F.lit(1)).alias("episodes"), F.sum(rows).alias("rows"), F.sum("checksum").alias("checksum"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in one.columns])).alias("e")).select("e.*")
