"""Half-open integer intervals by their ends alone: unions, depths and tilings, without a row for each point.

An interval adds one to the depth at its start and takes one away at its end.
Changes are summed by (key, place), so ends that meet cancel out before
anything is sorted.  A key's changes sum to zero, so the running sum over the
order of (key, place) of the whole table is every key's own depth: it is found
by ranges (``order``), and a key with most of the intervals is no single task.
Intervals that end where they start, or before, are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


def changes(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", weight: Column | None = None) -> DataFrame:
    """(keys, at, change): where the depth changes, and by how much."""
    w = F.lit(1) if weight is None else weight
    ends = F.array(F.struct(F.col(start).cast("long").alias("at"), w.cast("long").alias("w")), F.struct(F.col(end).cast("long").alias("at"), (-w).cast("long").alias("w")))
    rows = intervals.filter(F.col(start) < F.col(end)).select(*keys, F.explode(ends).alias("e"))
    return rows.groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.w").alias("change")).filter("change <> 0")


def depths(changed: DataFrame, keys: list[str]) -> DataFrame:
    """The changes with their place in the order of all, and the depth before and after."""
    placed = order.numbered(changed, [*keys, "at"], "place")
    return order.running_sum(placed, "place", "change", "before").withColumn("after", F.col("before") + F.col("change"))


def islands(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the union of each key's intervals as disjoint ones that don't touch."""
    edges = depths(changes(intervals, keys, start, end), keys).filter("(before = 0) <> (after = 0)")
    # starts and ends take turns over the whole order: two in a row are one island
    turns = order.running_sum(edges.withColumn("__one", F.lit(1)), "place", "__one", "__turn")
    return turns.groupBy(*keys, F.expr("__turn div 2").alias("__pair")).agg(F.min("at").alias("start"), F.max("at").alias("end")).drop("__pair")


def tiling_faults(intervals: DataFrame, parents: DataFrame, keys: list[str], length: str, start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, fault, depth): where intervals don't cover [0, length) of their parent exactly once.

    Parents count against the intervals, so a right tiling has no change left
    and costs nothing past one aggregation.  ``gap``: covered by none;
    ``overlap``: ``depth`` times too often; ``outside``: beyond the parent, or
    of a key without one.
    """
    parts = intervals.select(*keys, F.col(start).alias("s"), F.col(end).alias("e"), F.lit(1).alias("w"))
    whole = parents.select(*keys, F.lit(0).alias("s"), F.col(length).alias("e"), F.lit(-1).alias("w"))
    left = depths(changes(parts.unionByName(whole), keys, "s", "e", F.col("w")), keys)
    after = left.select((F.col("place") - 1).alias("place"), F.col("at").alias("until"))
    wrong = left.filter("after <> 0").join(after, "place")
    sizes = parents.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(length).alias("__length"))
    on = F.lit(True)
    for k in keys:
        on = on & wrong[k].eqNullSafe(sizes[f"__{k}"])
    inside = (F.col("at") >= 0) & (F.col("at") < F.coalesce("__length", F.lit(0)))
    fault = F.when(F.col("after") < 0, "gap").when(inside, "overlap").otherwise("outside")
    return wrong.join(sizes, on, "left").select(*keys, F.col("at").alias("start"), F.col("until").alias("end"), fault.alias("fault"), F.abs("after").alias("depth"))


def nearest(queries: DataFrame, values: DataFrame, query: str, value: str, columns: list[str], ties: str = "low") -> DataFrame:
    """Each query with the columns of the nearest value (null for a null query, or where there are no values).

    A two-sided as-of join over one order of queries and values together: the
    last value up to a query is a running maximum, the first one after it a
    running minimum from the end, both found by ranges, so neither a hot value
    nor a hot query is one task and nothing is compared pairwise.  Of two
    values as near the one that ``ties`` names wins; of rows with one value the
    least.
    """
    row = F.struct(F.col(value).cast("double").alias("v"), F.struct(*columns).alias("row"))
    known = values.filter(F.col(value).isNotNull()).select(row.alias("r")).groupBy(F.col("r.v").alias("x")).agg(F.min("r").alias("value"))
    asked = queries.select(F.col(query).cast("double").alias("x"), F.struct(*queries.columns).alias("query"), F.monotonically_increasing_id().alias("n"))
    both = known.select("x", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"), "value", F.lit(None).cast(dict(asked.dtypes)["query"]).alias("query")).unionByName(
        asked.select("x", F.lit(1).alias("kind"), "n", F.lit(None).cast(dict(known.dtypes)["value"]).alias("value"), "query"))
    placed = order.numbered(both, ["x", "kind", "n"], "place")
    placed = order.running_extreme(placed, "place", "value", "low", True)
    placed = order.running_extreme(placed, "place", "value", "high", False)
    down, up = F.col("x") - F.col("low.v"), F.col("high.v") - F.col("x")
    below = down < up if ties == "high" else down <= up
    best = F.when(F.col("high").isNull() | below, F.col("low")).otherwise(F.col("high"))
    best = F.when(F.col("x").isNotNull(), best)
    return placed.filter("kind = 1").select("query", best.alias("__best")).select("query.*", *[F.col(f"__best.row.{c}").alias(c) for c in columns])


def union_length(intervals: DataFrame, keys: list[str], by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(by, length): points covered at least once, for each value of some of the keys: the ends of the islands less their starts."""
    edges = depths(changes(intervals, keys, start, end), keys).filter("(before = 0) <> (after = 0)")
    return edges.groupBy(*by).agg(F.sum(F.when(F.col("after") == 0, F.col("at")).otherwise(-F.col("at"))).alias("length"))
