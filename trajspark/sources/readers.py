"""Scans: declared schemas, provenance columns, strict and tolerant modes, log parsing."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import StructType

from ..functions import scalars

#: The shapes of the log lines and the names of shard summaries.
METRIC_LINE = r"{name}\s*=\s*([-+0-9.eEinfa]+)"
ATTEMPT_SUMMARY, RANK_SUMMARY = r"^lineage_rank[0-9]_.*_summary\.json$", r"^lineage_rank[0-9]_summary\.json$"
TIMESTAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"

LINEAGE = (
    "format_version INT, run_id STRING, logical_run_id STRING, training_attempt_id STRING, resume_generation INT, checkpoint_base_step INT, "
    "occurrence_id STRING, lineage_part_id STRING, phase STRING, optimizer_step INT, optimizer_update_applied BOOLEAN, rank INT, world_size INT, "
    "microbatch_id INT, gradient_accumulation_index INT, sample_slot INT, source_view STRING, dataset STRING, task STRING, episode INT, "
    "dataset_index INT, local_dataset_index INT, sample_uid INT, requested_anchor_t INT, remapped_anchor_t INT, segment_start_t INT, "
    "segment_end_t INT, observation_timestamps ARRAY<INT>, action_target_timestamps ARRAY<INT>, valid_mask ARRAY<BOOLEAN>, "
    "loss_weights ARRAY<DOUBLE>, subset_manifest_id STRING, sampler_probability DOUBLE, frame_count INT, action_tokens_per_frame INT, "
    "padding_target_count INT, real_target_count INT, micro_count INT, planned_tokens INT"
)


def jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, malformed ones give nulls."""
    return spark.read.schema(schema).json(path)


def jsonl_strict(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str | list[str], separator: str | None = None) -> DataFrame:
    """(file, line, value): every line with its number from 1 in its file, however many tasks read the file.

    The scan splits files into blocks of bytes and reads each block's lines in
    order; a line's number is its place in the block and the count of lines of
    the file's blocks before, which is a row for each block.  Without a
    separator carriage returns end lines as well.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__m"), "value")
    counts = rows.groupBy("file", "__block").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    joined = rows.join(offsets, ["file", "__block"])
    return joined.select("file", (F.col("__before") + F.col("__m") - F.col("__first") + 1).alias("line"), "value")


def jsonl_errors(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of non-blank lines that hold no JSON object, in their order; the line is counted within its file."""
    bad = F.expr("try_parse_json(value)").isNull() | (F.ltrim("value").substr(1, 1) != "{")
    return numbered_lines(spark, path, "\n").filter(F.trim("value") != "").filter(bad).orderBy("file", "line")


def json_object(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def first_lines(df: DataFrame, n: int) -> DataFrame:
    """A limit that reaches the scan."""
    return df.limit(n)


def episodes(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Episode files with their id from the path; only the named columns are read."""
    reader = spark.read.option("recursiveFileLookup", True)
    df = (reader.schema(schema) if schema else reader).parquet(*([path] if isinstance(path, str) else path))
    kept = [f"`{c}`" for c in (columns or df.columns)]
    return df.select(F.regexp_extract(F.col("_metadata.file_path"), r"episode_(\d+)", 1).cast("long").alias("episode_index"), *kept)


def lineage_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lineage shards under the declared schema, so all-null columns keep their types."""
    return spark.read.schema(LINEAGE).parquet(*paths)


def shard_paths(spark: SparkSession, summaries: str) -> list[str]:
    """Files listed by the shard summaries; files that no summary lists don't count."""
    rows = spark.read.schema("rank INT, shards ARRAY<STRUCT<path: STRING, sha256: STRING>>").option("multiLine", True).json(summaries)
    return [r["path"] for r in rows.select(F.explode("shards").alias("s")).select("s.path").distinct().orderBy("path").collect()]


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256) that a folder's summaries of ranks list, each path once; summaries of whole ranks count only where no attempt has one."""
    found = spark.read.schema("rank INT, shards ARRAY<STRUCT<path: STRING, sha256: STRING>>").option("multiLine", True).option("pathGlobFilter", "lineage_rank*_summary.json").json(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = found.select("shards", F.when(name.rlike(ATTEMPT_SUMMARY), 1).when(name.rlike(RANK_SUMMARY), 2).alias("kind")).filter("kind is not null")
    chosen = rows.agg(F.min("kind").alias("kind"))  # one row
    return rows.join(F.broadcast(chosen), "kind").select(F.explode("shards").alias("s")).groupBy("s.path").agg(F.min("s.sha256").alias("sha256"))


def repositories(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Dataset directories under the roots, found by their info.json, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "info.json").load(roots)
    found = files.select(F.regexp_extract("path", r"^(.*)/meta/info\.json$", 1).alias("repository")).filter("repository <> ''")
    return found.distinct().withColumn("dataset", F.element_at(F.split("repository", "/"), -1)).orderBy("repository")


def inventory(spark: SparkSession, path: str | list[str], glob: str = "*", digests: bool = True) -> DataFrame:
    """(path, size, sha256) of files; without digests the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    cols = [F.col("path"), F.col("length").alias("size")]
    return files.select(*cols, F.sha2("content", 256).alias("sha256")) if digests else files.select(*cols)


def tree_digest(files: DataFrame) -> DataFrame:
    """One SHA-256 of a tree from its sorted (path, sha256) lines."""
    listed = F.array_sort(F.collect_list(F.concat_ws("  ", "sha256", "path")))
    return files.agg(F.sha2(F.array_join(listed, "\n"), 256).alias("tree_sha256"))


def csv_rows(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path).withColumn("source_csv", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, line): carriage returns end lines as well; n counts from 0."""
    return numbered_lines(spark, path).select("file", (F.col("line") - 1).alias("n"), F.col("value").alias("line"))


def metric(line: str | Column, name: str) -> Column:
    """name=number in a line; null if there is none."""
    return F.regexp_extract(scalars.c(line), METRIC_LINE.format(name=name), 1).try_cast("double")


def last_by_step(lines: DataFrame, metrics: list[str], order: str = "n") -> DataFrame:
    """Metric lines by step, the last line of a step winning."""
    rows = lines.select(metric("line", "step").cast("long").alias("step"), *[metric("line", m).alias(m) for m in metrics], order)
    rows = rows.filter(F.col("step").isNotNull() & F.col(metrics[0]).isNotNull())
    return rows.groupBy("step").agg(*[F.max_by(m, order).alias(m) for m in metrics])


def first_of_tuple(lines: DataFrame, metrics: list[str], order: str = "n") -> DataFrame:
    """Metric lines without repeats of the same values; the first place stays."""
    rows = lines.select(*[metric("line", m).alias(m) for m in metrics], order).dropna(subset=metrics)
    return rows.groupBy(*metrics).agg(F.min(order).alias(order))


def log_span_hours(lines: DataFrame) -> DataFrame:
    """Hours between the first and the last timestamp of the lines."""
    at = F.try_to_timestamp(F.regexp_extract("line", TIMESTAMP, 1))
    return lines.select(at.alias("at")).agg(scalars.span_hours(F.min("at"), F.max("at")).alias("hours"))


def gpu_peaks(lines: DataFrame) -> DataFrame:
    """Greatest used MiB by GPU from CSV monitor lines; headers and lines of under six columns are skipped."""
    parts = F.split("line", r"\s*,\s*")
    rows = lines.filter(F.size(parts) >= 6).select(parts[1].try_cast("int").alias("gpu"), F.regexp_extract(parts[2], r"([0-9.]+)", 1).try_cast("double").alias("used_mib"))
    return rows.dropna().groupBy("gpu").agg(F.max("used_mib").alias("peak_mib"))


def key_values(lines: DataFrame, keys: list[str], order: str = "n") -> DataFrame:
    """'Key: number' lines of each file, the last one of a key winning."""
    found = [
        F.max_by(F.regexp_extract("line", rf"{k}:\s*([-+0-9.eE]+)", 1).try_cast("double"), F.when(F.regexp_extract("line", rf"{k}:\s*([-+0-9.eE]+)", 1).try_cast("double").isNotNull(), F.col(order)))
        .alias(k.lower().replace(" ", "_")) for k in keys
    ]
    return lines.groupBy("file").agg(*found)


def results(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Result JSON files with suite and task from their paths (two groups of the pattern)."""
    schema = "succ_num DOUBLE, total_num DOUBLE, succ_rate DOUBLE, eval_protocol STRING, max_env_steps INT, num_steps_wait INT, initial_state_mode STRING"
    at = F.col("_metadata.file_path")
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return df.select(F.regexp_extract(at, pattern, 1).alias("suite"), F.regexp_extract(at, pattern, 2).alias("task"), "*")


def rollouts(spark: SparkSession, path: str) -> DataFrame:
    """Successes by folder from file names that end in True.mp4 or False.mp4; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(path).select("path")
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("task"), F.col("path").endswith("True.mp4").alias("ok"), F.col("path").endswith("False.mp4").alias("failed"))
    return rows.filter("ok or failed").groupBy("task").agg(F.count_if("ok").alias("succ_num"), F.count(F.lit(1)).alias("total_num"))


def region_ranges(text: str | Column) -> Column:
    """All groups of four numbers in parentheses of a layout description, as arrays of doubles."""
    groups = F.regexp_extract_all(scalars.c(text), F.lit(r"\(\s*([-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+)\s*\)"), 1)
    return F.transform(groups, lambda g: F.transform(F.split(g, r"\s+"), lambda x: x.try_cast("double")))


def _headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            size = struct.unpack("<Q", content[:8])[0]
            for name, spec in sorted(json.loads(content[8 : 8 + size]).items()):
                if name != "__metadata__":
                    rows.append((path, name, spec["dtype"], [int(n) for n in spec["shape"]]))
        yield pd.DataFrame(rows, columns=["path", "name", "dtype", "shape"])


def tensor_schema(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape) from the headers of tensor files: 8 bytes of length, then JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(_headers, "path string, name string, dtype string, shape array<long>")


def schema_digest(tensors: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.to_json(F.struct("name", "dtype", "shape"))))
    return tensors.groupBy("path").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("schema_sha256"))


def profile(spark: SparkSession, path: str) -> dict:
    """Columns and one row of a Parquet path, or what went wrong instead."""
    try:
        df = spark.read.parquet(path)
        row = df.limit(1).collect()
        return {"path": path, "columns": df.columns, "row": row[0].asDict(recursive=True) if row else None, "error": None}
    except Exception as e:  # the error is the result
        return {"path": path, "columns": None, "row": None, "error": f"{type(e).__name__}: {str(e).splitlines()[0]}"}
