"""Tables written in the middle of a job, in the folder that the cluster shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no ``spark.checkpoint.dir`` (tests on one machine).
LOCAL = "/tmp/checkpoints"
_WRITTEN: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else f"{LOCAL}/{os.getpid()}"


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, until :func:`release`."""
    _WRITTEN.append(f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def release(spark: SparkSession) -> None:
    """Remove what this process wrote; DataFrames that read it are no longer usable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` as a table and read it; a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
