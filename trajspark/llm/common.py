"""Helpers shared by the corpus operators: scratch tables, bucketed ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize, release  # noqa: F401  (for the operators of this subpackage)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the stock tables, read by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches over the same memory: what a Python worker unpacks at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bucket_count(rows: int, groups: int, per_bucket: int = 2_000, most: int = 1024) -> int:
    """Buckets for each group so that a bucket holds about ``per_bucket`` rows.

    ``groups * most`` bounds the offset table of :func:`with_rank` whatever the input.
    """
    return max(1, min(most, -(-rows // (per_bucket * max(groups, 1)))))


def with_rank(df: DataFrame, group: str, order: list[Column], bucket: Column, out: str) -> DataFrame:
    """Gapless rank from 0 within ``group`` without one task for each group.

    Rows are ranked inside (group, bucket); the bucket's first rank is the
    running count of the buckets before it.  The offset table has one row for
    each (group, bucket), both bounded, so broadcasting it is safe.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(group).alias("__g"), F.col("__bucket").alias("__b"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(group, "__bucket").orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(inside) - 1)
    joined = ranked.join(
        F.broadcast(offsets),
        ranked[group].eqNullSafe(offsets["__g"]) & (ranked["__bucket"] == offsets["__b"]),
        "left",
    )
    return joined.withColumn(out, (F.col("__before") + F.col("__r")).cast("long")).drop(
        "__bucket", "__g", "__b", "__before", "__r"
    )
