"""Data-quality rules: DataFrames of (rule, key, error); a check passes if there are no rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, all rules in one pass; a rule is a condition for an error, null is none."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, found)


def verdict(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("errors")).withColumn("passed", F.col("errors") == 0)


def episode_rules(episodes: DataFrame, total: int | None = None) -> DataFrame:
    """Unique ids, more than one row, one config that covers the episode, one text."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("episode_index"))
    rows = episodes.withColumn("__copies", copies)
    config = F.col("action_config")
    found = violations(rows, "episode_index", {
        "duplicate_episode": F.col("__copies") > 1, "too_short": F.col("length") <= 1, "not_one_config": F.size(config) != 1,
        "not_covering": (F.get(config, F.lit(0))["start_frame"] != 0) | (F.get(config, F.lit(0))["end_frame"] != F.col("length")),
        "not_one_task": F.size("tasks") != 1,
    })
    if total is None:
        return found
    count = episodes.agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(violations(count.withColumn("k", F.lit("all")), "k", {"episode_count": F.col("n") != total}))


def manifest_rules(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest (path, size, sha256) against files (path, size, sha256): format, safety, presence, sizes, digests."""
    m = manifest.withColumn("sha256", F.lower("sha256"))
    form = violations(m, "path", {"unsafe_path": ~scalars.is_safe_relative_path("path"), "bad_digest": ~scalars.is_sha256("sha256")})
    both = m.join(files.select("path", F.col("size").alias("__size"), F.lower("sha256").alias("__sha")), "path", "full_outer")
    present = violations(both, "path", {
        "missing_file": F.col("__sha").isNull(), "unlisted_file": F.col("sha256").isNull(), "size": F.col("size") != F.col("__size"), "digest": F.col("sha256") != F.col("__sha"),
    })
    return form.unionByName(present)


def expected_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every key of a bounded catalogue against every one of another (episodes x cameras)."""
    return left.distinct().crossJoin(F.broadcast(right.distinct()))  # the right side is a fixed list of cameras


def agreement(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose rows disagree in a field (camera frames, shapes, digests)."""
    found = df.groupBy(key).agg(*[F.count_distinct(F.to_json(F.struct(f))).alias(f"__{f}") for f in fields])
    return violations(found, key, {f"differing_{f}": F.col(f"__{f}") > 1 for f in fields})


def complete_groups(df: DataFrame, keys: list[str], member: str, expected: int) -> DataFrame:
    """Keys that have all of the expected members (all cameras exist)."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("n")).filter(F.col("n") == expected).drop("n")


def id_selection(known: DataFrame, wanted: list[int], key: str) -> DataFrame:
    """Rules for an explicit id list: not empty, no repeats, all known."""
    spark = known.sparkSession
    rows = spark.createDataFrame([(i,) for i in wanted], f"{key} long")
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    flagged = counted.join(known.select(key, F.lit(True).alias("known")).distinct(), key, "left")
    found = violations(flagged, key, {"repeated": F.col("n") > 1, "unknown": F.col("known").isNull()})
    if not wanted:
        found = found.unionByName(spark.createDataFrame([("all", "empty_selection")], "key string, rule string"))
    return found


def optimizer_state_rules(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Two optimizer inventories: same groups and order, states present or legally empty, same shapes and dtypes."""
    fields = ["optimizer_group_index", "position_in_group", "parameter_shape", "parameter_dtype", "optimizer_state_present", "has_received_gradient"]
    l = saved.select("parameter_name", F.struct(*fields).alias("s"))
    r = current.select("parameter_name", F.struct(*fields).alias("c"))
    both = l.join(r, "parameter_name", "full_outer")
    same = lambda f: ~F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}"))
    matched = F.col("s").isNotNull() & F.col("c").isNotNull()
    return violations(both, "parameter_name", {
        "missing": F.col("c").isNull(), "unexpected": F.col("s").isNull(), "group": matched & same("optimizer_group_index"), "order": matched & same("position_in_group"),
        "shape": matched & same("parameter_shape"), "dtype": matched & same("parameter_dtype"),
        "empty_state": matched & ~F.col("s.optimizer_state_present") & F.col("s.has_received_gradient"),
    })


def marker_rules(marker: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A success marker (name, sha256) must pin exactly the artifacts there are."""
    return manifest_rules(
        marker.select(F.col("name").alias("path"), F.lit(0).alias("size"), "sha256"), artifacts.select(F.col("name").alias("path"), F.lit(0).alias("size"), "sha256")
    )
