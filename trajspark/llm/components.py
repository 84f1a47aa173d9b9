"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.shiftright(F.xxhash64("v", "u"), 40)).alias("s"),
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root): root is the smallest vertex reachable, for each vertex that has an edge.

    ``edges`` has long columns u and v, in any direction, repeats and loops
    allowed.  Each round is two grouped minima and two joins, written to the
    shared scratch folder; nothing of the graph goes to the driver.  Rounds grow
    with the logarithm of the longest path; they end when nothing changes.
    """
    edges = edges.select("u", "v").filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    edges = materialize(edges, "cc")
    seen = _mark(edges)
    settled = seen[0] == 0
    while not settled:
        edges = materialize(_small_star(_large_star(edges)), "cc")
        now = _mark(edges)
        settled, seen = now == seen, now
    roots = edges.select("v").distinct().select(F.col("v").alias("vertex"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(roots)
