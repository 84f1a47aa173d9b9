"""Sinks: Parquet, JSON lines, CSV, atomic small files, Markdown cards, digests, views."""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", by: list[str] | None = None) -> None:
    """Spark's commit protocol publishes the files together."""
    writer = df.write.mode(mode).option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def lineage_shards(df: DataFrame, path: str, steps_per_shard: int) -> None:
    """Records by dataset of shards, each covering a fixed range of optimizer steps."""
    shard = F.floor(F.col("optimizer_step") / F.lit(steps_per_shard)).cast("int")
    df.withColumn("shard", shard).repartition("shard").write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)


def lineage_index(spark: SparkSession, path: str) -> DataFrame:
    """(shard, files, rows, bytes, first_step, last_step, sha256) of written shards; sha256 is over the files' own digests in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard")
    listed = files.select(shard, "length", F.sha2("content", 256).alias("d")).groupBy("shard").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), "\n"), 256).alias("sha256"))
    rows = spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.min("optimizer_step").alias("first_step"), F.max("optimizer_step").alias("last_step"))
    return rows.join(listed, "shard")


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def _file_system(path: str):
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def atomic_bytes(path: str, data: bytes) -> None:
    """A file, in any store that Spark writes to, that readers see whole or not at all: written beside its place, then moved over it."""
    jvm, conf, at, fs = _file_system(path)
    beside = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    try:
        out = fs.create(beside, True)
        out.write(bytearray(data))
        out.close()
        options = SparkSession.active().sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(at), options)
    except BaseException:
        fs.delete(beside, False)
        raise


def atomic_json(path: str, value: object) -> None:
    atomic_bytes(path, (json.dumps(value, sort_keys=True, indent=2, default=str) + "\n").encode())


def _cell(value: object) -> str:
    if value is None:
        return ""
    return (f"{value:.10g}" if isinstance(value, float) else str(value)).replace("|", "/")


def markdown(df: DataFrame, title: str) -> str:
    """A small table (a card has a few dozen rows) as Markdown."""
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(_cell(v) for v in row) + " |" for row in df.collect()]
    return "\n".join(lines) + "\n"


def digests(folder: str) -> str:
    """Sorted SHA-256 lines of a local folder's files, written as SHA256SUMS."""
    root = Path(folder)
    names = sorted(p.relative_to(root).as_posix() for p in root.rglob("*") if p.is_file() and p.name != "SHA256SUMS" and p.suffix != ".crc")
    text = "".join(f"{hashlib.sha256((root / n).read_bytes()).hexdigest()}  {n}\n" for n in names)
    atomic_bytes(str(root / "SHA256SUMS"), text.encode())
    return text


def bundle(folder: str, target: str) -> None:
    root = Path(folder)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and p.suffix != ".crc":
                z.write(p, p.relative_to(root).as_posix())


def view(df: DataFrame, name: str) -> None:
    """A filtered dataset as a view: nothing is copied."""
    df.createOrReplaceTempView(name)


def published(df: DataFrame, path: str, marker: dict) -> None:
    """Data first, the success marker last; the old marker goes before anything is written."""
    at = f"{path.rstrip('/')}/_PUBLISHED.json"
    _, _, place, fs = _file_system(at)
    fs.delete(place, False)
    parquet(df, path, mode="overwrite")
    atomic_json(at, marker)


def read_json(path: str) -> dict | None:
    """A small JSON file of any store; None where there is none."""
    jvm, _, place, fs = _file_system(path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def marker_of(path: str) -> dict | None:
    """The success marker of what :func:`published` wrote; None where there is none."""
    return read_json(f"{path.rstrip('/')}/_PUBLISHED.json")
