"""Evaluation results: completeness, macro and micro rates, checkpoints, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import order


def result_status(succ: str, total: str, rate: str, expected: int) -> Column:
    """'complete', or why not: missing, unreadable, inconsistent, partial."""
    s, n, r = F.col(succ), F.col(total), F.col(rate)
    readable = scalars.is_integer_count(s) & scalars.is_integer_count(n) & scalars.is_finite(r)
    agree = (s <= n) & scalars.is_close(r, F.coalesce(F.try_divide(s, n), F.lit(0.0)))
    return (
        F.when(s.isNull() & n.isNull() & r.isNull(), "missing").when(~readable, "unreadable")
        .when(~F.coalesce(agree, F.lit(False)), "inconsistent").when(n < expected, "partial").otherwise("complete")
    )


def completeness(expected_tasks: DataFrame, results: DataFrame, task: str, expected: int) -> DataFrame:
    rows = expected_tasks.select(task).distinct().join(results, task, "left")
    return rows.withColumn("status", result_status("succ_num", "total_num", "succ_rate", expected))


def incomplete(expected_tasks: DataFrame, results: DataFrame, task: str, expected: int) -> DataFrame:
    """What a retry round has to run again."""
    return completeness(expected_tasks, results, task, expected).filter("status <> 'complete'").select(task, "status")


def rates(results: DataFrame, group: str) -> DataFrame:
    """Macro average (of rates, nulls skipped) and micro average (pooled) by group, and over all (null group)."""
    return results.groupingSets([[group], []], group).agg(
        F.avg("succ_rate").alias("macro_rate"), F.try_divide(F.sum("succ_num"), F.sum("total_num")).alias("micro_rate"), F.count(F.lit(1)).alias("tasks"),
        F.grouping(group).cast("int").alias("is_total"),
    )


def pooled_faults(expected_tasks: DataFrame, results: DataFrame, task: str, expected: int, protocol: dict[str, object]) -> DataFrame:
    """(task, fault) of what must not be pooled: results that are missing or not complete, repeated, of a task that isn't expected, or of another protocol."""
    counted = results.groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    status = completeness(expected_tasks, results, task, expected).filter("status <> 'complete'").select(task, F.col("status").alias("fault"))
    repeated = counted.filter("n > 1").select(task, F.lit("repeated").alias("fault"))
    unknown = counted.join(expected_tasks.select(task), task, "left_anti").select(task, F.lit("unexpected").alias("fault"))
    other = [results.filter(~F.col(f).eqNullSafe(F.lit(v))).select(task, F.lit(f"protocol_{f}").alias("fault")) for f, v in protocol.items()]
    found = status.unionByName(repeated).unionByName(unknown)
    for rows in other:
        found = found.unionByName(rows)
    return found.distinct()


def pooled_success(expected_tasks: DataFrame, results: DataFrame, task: str, group: str, expected: int, protocol: dict[str, object]) -> DataFrame:
    """(group, succ, total, pooled_rate, faults) by group of the expected tasks; a group with a fault has no rate."""
    faults = pooled_faults(expected_tasks, results, task, expected, protocol).groupBy(task).agg(F.count(F.lit(1)).alias("__f"))
    own = results.groupBy(task).agg(F.sum("succ_num").alias("__s"), F.sum("total_num").alias("__n"))
    rows = expected_tasks.select(task, group).join(own, task, "left").join(faults, task, "left")
    sums = rows.groupBy(group).agg(F.sum("__s").alias("succ"), F.sum("__n").alias("total"), F.coalesce(F.sum("__f"), F.lit(0)).cast("long").alias("faults"))
    return sums.select(group, "succ", "total", F.when(F.col("faults") == 0, F.try_divide("succ", "total")).alias("pooled_rate"), "faults")


def resumable(counters: DataFrame, results: DataFrame, task: str, config: list[str]) -> DataFrame:
    """(task, succ_num, total_num, status) to go on from: earlier counters where they were made with the same configuration, 'mismatch' where not, 'fresh' where there are none."""
    kept = results.select(task, "succ_num", "total_num", F.struct(*config).alias("__old"))
    rows = counters.select(task, F.struct(*config).alias("__new")).join(kept, task, "left")
    same = F.col("__old").eqNullSafe(F.col("__new"))
    status = F.when(F.col("__old").isNull(), "fresh").when(same, "resumed").otherwise("mismatch")
    value = lambda n: F.when(status == "resumed", F.col(n)).otherwise(F.lit(0)).alias(n)
    return rows.select(task, value("succ_num"), value("total_num"), status.alias("status"))


def best_checkpoint(rounds: DataFrame) -> DataFrame:
    """The step with the most successes, the later one of equals."""
    return rounds.agg(F.max_by(F.struct("step", "succ"), F.struct("succ", "step")).alias("b")).select("b.*")


def round_summary(results: DataFrame) -> DataFrame:
    """Sums by step with a map of the tasks' own counts."""
    return results.groupBy("step").agg(
        F.sum("succ_num").alias("succ"), F.sum("total_num").alias("total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "succ_num")))).alias("by_task"),
    )


def result_order(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("succ_rate").desc_nulls_last(), "task")


def places(results: DataFrame) -> DataFrame:
    """The same order as a column: highest rate first, results without one last."""
    return order.numbered(results, [F.col("succ_rate").desc_nulls_last(), F.col("task")], "place")


def global_batch_means(batches: DataFrame, losses: list[str], labels: str) -> DataFrame:
    """One row: each loss averaged over the batches of all ranks, the labels summed."""
    return batches.agg(*[F.try_divide(F.sum(x), F.count(F.lit(1)).cast("double")).alias(f"mean_{x}") for x in losses], F.sum(labels).alias(labels), F.count(F.lit(1)).alias("batches"))


def retry(expected_tasks: list[str], run, rounds: int) -> tuple[list[str], list[str]]:
    """Driver loop: run what is incomplete, at most ``rounds`` times. ``run(task, round)`` tells whether it is complete."""
    left, done = list(expected_tasks), []
    for n in range(rounds):
        finished = [t for t in left if run(t, n)]
        done += finished
        left = [t for t in left if t not in finished]
        if not left:
            break
    return done, left


def ledger(runs: DataFrame, unique: str, seen: str, hours: str, suite: str) -> DataFrame:
    """Unique and seen labels, replay and hours by suite, with a total row (null suite)."""
    return runs.rollup(suite).agg(
        F.sum(unique).alias("c_unique"), F.sum(seen).alias("c_seen"), F.try_divide(F.sum(seen).cast("double"), F.sum(unique).cast("double")).alias("replay"),
        F.sum(hours).alias("hours"), F.min(seen).alias("least_seen"), F.max(seen).alias("most_seen"),
    )


def timing(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """Sum of each rank over its attempts, then greatest, mean and sum over ranks."""
    by_rank = rows.groupBy(rank).agg(F.sum(value).alias("s"))
    return by_rank.agg(
        F.max("s").alias("rank_max"), F.avg("s").alias("rank_mean"), F.sum("s").alias("rank_sum"), F.sort_array(F.collect_list("s")).alias("ranks")
    )


def equal_episode_mean(rows: DataFrame, episode: str, value: str, configured: int) -> DataFrame:
    """Sum over episodes of their mean, divided by the configured number of episodes."""
    means = rows.groupBy(episode).agg(F.avg(value).alias("m"))
    return means.agg((F.sum("m") / F.lit(float(configured))).alias("loss"))


def masked_mean(rows: DataFrame, frame: str, value: str, weight: str, mask: str) -> DataFrame:
    """Mean over frames of sum(value * weight * mask) / (sum(mask) + 1e-6)."""
    m = F.col(mask).cast("double")
    frames = rows.groupBy(frame).agg((F.sum(F.col(value) * F.col(weight) * m) / (F.sum(m) + 1e-6)).alias("f"))
    return frames.agg(F.avg("f").alias("loss"))
