"""The stock tables in the roles of the engine's entities, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences

RUN = "run"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flat target slots; a target of -1 is padding."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("task"), F.col("l_suppkey").alias("episode"),
        (F.pmod("l_partkey", F.lit(17)) - 1).alias("target_t"), F.col("l_discount").alias("weight"), (F.col("l_tax") < 0.08).alias("valid"),
        (F.col("l_quantity") > 1).alias("optimizer_update_applied"), F.col("l_linenumber").alias("optimizer_step"),
        F.col("l_linenumber").alias("resume_generation"), F.col("l_orderkey").alias("occurrence_id"), F.pmod("l_suppkey", F.lit(4)).alias("rank"),
        F.col("l_returnflag").alias("source_view"), F.col("l_linestatus").alias("phase"), F.pmod("l_suppkey", F.lit(5)).alias("training_attempt_id"),
    )


SLOTS = """slots AS (SELECT l_returnflag AS dataset, l_linestatus AS task, l_suppkey AS episode, l_partkey % 17 - 1 AS target_t,
  l_discount AS weight, l_tax < 0.08 AS valid, l_quantity > 1 AS done, l_linenumber AS optimizer_step, l_linenumber AS generation,
  l_orderkey AS occurrence, l_suppkey % 4 AS rank, l_suppkey % 5 AS attempt FROM lineitem),
hits AS (SELECT * FROM slots WHERE done AND target_t >= 0 AND valid AND weight > 0),
seen AS (SELECT dataset, task, episode, target_t, sum(weight) AS ew, count(*) AS eu, min(optimizer_step) AS first_step, max(optimizer_step) AS last_step
  FROM hits GROUP BY ALL)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items nested into records by order and line number, with parallel arrays."""
    slot = F.struct(
        (F.pmod("l_partkey", F.lit(17)) - 1).cast("int").alias("t"), F.col("l_discount").alias("w"), (F.col("l_tax") < 0.08).alias("v"),
    )
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.array_sort(F.collect_list(slot)).alias("s"), F.min("l_returnflag").alias("dataset"), F.min("l_linestatus").alias("task"),
        F.min("l_suppkey").alias("episode"), (F.min("l_quantity") > 1).alias("optimizer_update_applied"),
    )

    def part(name: str) -> Column:
        return F.transform("s", lambda x: x[name])

    return grouped.select(
        "dataset", "task", "episode", "optimizer_update_applied", F.col("l_linenumber").alias("optimizer_step"), F.col("dataset").alias("source_view"),
        part("t").alias("action_target_timestamps"), part("v").alias("valid_mask"), part("w").alias("loss_weights"),
    )


RECORDS = """records AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS dataset, min(l_linestatus) AS task, min(l_suppkey) AS episode,
  min(l_quantity) > 1 AS done FROM lineitem GROUP BY ALL),
slots AS (SELECT r.dataset, r.task, r.episode, r.done, l.l_partkey % 17 - 1 AS target_t, l.l_discount AS weight, l.l_tax < 0.08 AS valid
  FROM lineitem l JOIN records r USING (l_orderkey, l_linenumber)),
seen AS (SELECT dataset, task, episode, target_t, sum(weight) AS ew, count(*) AS eu FROM slots
  WHERE done AND target_t >= 0 AND valid AND weight > 0 GROUP BY ALL)"""


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.lit("A").alias("dataset"), F.lit("F").alias("task"), F.col("l_suppkey").alias("episode"), F.pmod("l_partkey", F.lit(64)).alias("target_t")
    ).distinct()


def seen_of_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_discount > 0.08")
    return rows.groupBy(F.col("l_suppkey").alias("episode"), F.pmod("l_partkey", F.lit(64)).alias("target_t")).agg(
        F.count(F.lit(1)).alias("exposure_unweighted"), F.sum("l_discount").alias("exposure_weighted")
    )


ELIGIBLE = """eligible AS (SELECT DISTINCT l_suppkey AS episode, l_partkey % 64 AS target_t FROM lineitem),
seen AS (SELECT l_suppkey AS episode, l_partkey % 64 AS target_t, count(*) AS eu, sum(l_discount) AS ew FROM lineitem
  WHERE l_quantity > 45 AND l_discount > 0.08 GROUP BY ALL)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes of time steps."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return sequences.with_step(rows, ["user_id"], ["ts", "event_id"])


SERIES = """series AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"""

SEGMENT, STRIDE = 8, 6


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("length"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping segments of each user's events, with the summed motion of their steps."""
    from ..operators import selectors

    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(STRIDE).cast("long"))
    rows = lengths(spark, sf_dir).select("episode", "length", F.posexplode(starts).alias("segment", "start"))
    rows = rows.withColumn("end", F.least(F.col("start") + SEGMENT, "length"))
    rows = rows.select("episode", "segment", "start", "end", F.col("start").alias("first"), (F.col("end") - 1).alias("last"))
    steps = motion(spark, sf_dir).select(F.col("user_id").alias("episode"), "t", "motion")
    return selectors.with_motion(rows, steps).withColumn("motion_score", F.round("motion_score", 6))


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.array(F.col("value"), F.pmod("event_id", F.lit(7)).cast("double"), F.pmod("event_id", F.lit(2)).cast("double"))
    return sequences.motion_score(series(spark, sf_dir).withColumn("action", action), "action", ["user_id"], ["t"], gripper=(2,))


MOTION = SERIES + """,
lagged AS (SELECT *, lag(value) OVER w AS v0, lag(event_id) OVER w AS e0 FROM series WINDOW w AS (PARTITION BY user_id ORDER BY t)),
motion AS (SELECT user_id, event_id, t, CASE WHEN v0 IS NULL THEN 0.0 ELSE sqrt((value - v0) ** 2 + (event_id % 7 - e0 % 7) ** 2 + (event_id % 2 - e0 % 2) ** 2)
  + 2 * abs(event_id % 2 - e0 % 2) END AS motion FROM lagged)"""

SEGMENTS = MOTION + f""",
len AS (SELECT user_id AS episode, count(*) AS length FROM events GROUP BY 1),
seg0 AS (SELECT episode, length, unnest(generate_series(0, length - 1, {STRIDE})) AS start FROM len),
seg1 AS (SELECT episode, length, start, start // {STRIDE} AS segment, least(start + {SEGMENT}, length) AS fin FROM seg0),
segs AS (SELECT s.episode, s.segment, s.start, s.fin, s.start AS first, s.fin - 1 AS last, round(sum(m.motion), 6) AS motion_score
  FROM seg1 s JOIN motion m ON m.user_id = s.episode AND m.t >= s.start AND m.t < s.fin GROUP BY ALL),
acts AS (SELECT episode, segment, unnest(generate_series(first, last)) AS action FROM segs)"""


def packing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items to pack: index, tokens in multiples of 128, shape by language."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("index"), (F.ceil(F.col("n_chars") / F.lit(128)) * 128).cast("long").alias("token_count"), F.col("lang").alias("shape_signature")
    )
