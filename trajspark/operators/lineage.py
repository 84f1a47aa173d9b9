"""Lineage records to effective targets: explode, acceptance, the central predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import intervals

TARGET = ["dataset", "task", "episode", "target_t"]


def committed(records: DataFrame) -> DataFrame:
    return records.filter("optimizer_update_applied")


def accept_latest(records: DataFrame, key: str = "occurrence_id", generation: str = "resume_generation") -> DataFrame:
    """All rows of an occurrence's greatest generation, repeats at that generation included."""
    latest = Window.partitionBy(key)
    return records.withColumn("__g", F.max(generation).over(latest)).filter(F.col(generation) == F.col("__g")).drop("__g")


def explode_targets(records: DataFrame) -> DataFrame:
    """One row for each target slot; parallel arrays end at the shortest, null arrays are empty."""

    def known(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))

    times, valid, weights = known("action_target_timestamps", "int"), known("valid_mask", "boolean"), known("loss_weights", "double")
    n = F.least(F.size(times), F.size(valid), F.size(weights))
    slots = F.arrays_zip(
        F.slice(times, F.lit(1), n).alias("target_t"), F.slice(valid, F.lit(1), n).alias("valid"), F.slice(weights, F.lit(1), n).alias("weight")
    )
    kept = [x for x in records.columns if x not in ("action_target_timestamps", "valid_mask", "loss_weights", "observation_timestamps")]
    return records.select(*kept, F.explode(slots).alias("s")).select(*kept, "s.target_t", "s.valid", "s.weight")


def is_padding() -> Column:
    return F.col("target_t") < 0


def is_effective() -> Column:
    """A real target that is valid and has positive weight."""
    return (F.col("target_t") >= 0) & F.col("valid") & (F.col("weight") > 0)


def slot_totals(slots: DataFrame, *group: str) -> DataFrame:
    """Slots by kind: padding, invalid (or weightless) and effective, among committed rows."""
    return slots.filter("optimizer_update_applied").groupBy(*group).agg(
        F.count_if(is_padding()).alias("padding_slots"),
        F.count_if(~is_padding() & ~is_effective()).alias("invalid_slots"),
        F.count_if(is_effective()).alias("effective_slots"),
    )


def slot_totals_all_rows(slots: DataFrame, *group: str) -> DataFrame:
    """The same kinds where padding counts on all rows, and an uncommitted real slot counts as invalid."""
    done = F.col("optimizer_update_applied")
    return slots.groupBy(*group).agg(
        F.count_if(is_padding()).alias("padding_slots"),
        F.count_if(~is_padding() & ~(is_effective() & done)).alias("invalid_slots"),
        F.count_if(is_effective() & done).alias("effective_slots"),
        F.sum(F.when(is_padding(), F.col("weight")).otherwise(0.0)).alias("padding_mass"),
        F.sum(F.when(is_effective() & done, F.col("weight")).otherwise(0.0)).alias("action_mass"),
    )


def exposures(slots: DataFrame, *extra: str) -> DataFrame:
    """Exposure of each target: weighted, counted, when, by whom."""
    hit = slots.filter("optimizer_update_applied").filter(is_effective())
    return hit.groupBy(*extra, *TARGET).agg(
        F.sum("weight").alias("exposure_weighted"), F.count(F.lit(1)).alias("exposure_unweighted"),
        F.min("optimizer_step").alias("first_step"), F.max("optimizer_step").alias("last_step"),
    )


def exposures_with_sets(slots: DataFrame, sets: tuple[str, ...] = ("source_view", "phase")) -> DataFrame:
    """Exposures with the sorted sets of views and phases (or of other columns: subset manifests), each named in the plural, and the number of ranks."""
    hit = slots.filter("optimizer_update_applied").filter(is_effective())
    return hit.groupBy(*TARGET).agg(
        F.sum("weight").alias("exposure_weighted"), F.count(F.lit(1)).alias("exposure_unweighted"),
        F.min("optimizer_step").alias("first_step"), F.max("optimizer_step").alias("last_step"),
        *[F.sort_array(F.collect_set(name)).alias(f"{name}s") for name in sets],
        F.count_distinct("rank").alias("rank_count"),
    )


def label_exposure(eligible: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The eligible universe with its exposures, zero where a target was never seen."""
    found = seen.withColumn("seen", F.lit(True))
    return eligible.select(*keys).distinct().join(found, keys, "left").withColumns({
        "seen": F.coalesce("seen", F.lit(False)), "exposure_unweighted": F.coalesce("exposure_unweighted", F.lit(0).cast("long")),
        "exposure_weighted": F.coalesce("exposure_weighted", F.lit(0.0)),
    })


def duplicate_occurrences(records: DataFrame, key: str = "occurrence_id") -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def attempts_by_step(records: DataFrame) -> DataFrame:
    return records.groupBy("optimizer_step").agg(F.sort_array(F.collect_set("training_attempt_id")).alias("attempts"))


def comparable(records: DataFrame, drop: list[str]) -> DataFrame:
    """Records without the fields that name an attempt."""
    return records.drop(*drop)


def step_range(records: DataFrame, first: int, last: int, step: str = "optimizer_step") -> DataFrame:
    """Records of the steps from first to last, both included."""
    return records.filter(F.col(step).between(first, last))


def target_times(frames: Column, stride: int = 4, prefix_frames: int = 4, real: Column | None = None) -> Column:
    """Padding prefix, real targets in order, padding tail: one slot for each action of a frame sequence."""
    prefix = stride * prefix_frames
    wanted = F.greatest(((frames - 1) / F.lit(stride)).cast("int") * stride * prefix_frames, F.lit(0))
    have = wanted if real is None else F.least(wanted, real)
    times = F.when(have > 0, F.sequence(F.lit(0), have.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    tail = (wanted - have).cast("int")
    return F.concat(F.array_repeat(F.lit(-1), prefix), times, F.array_repeat(F.lit(-1), tail))


def support_ranges(episodes: DataFrame, per_latent: int = 4) -> DataFrame:
    """(dataset, task, episode, start, end) of the targets that the configs of each episode can reach, as ranges.

    An episode has a nested ``action_config`` (start_frame, end_frame,
    action_text, frame_ids); a config without frames reaches nothing, one with
    a single frame is left to :func:`support_violations`.  The first latent's
    slots are padding; the rest reach from the first frame on, as far as the
    config goes.  The task is the config's text, or else the episode's first.
    """
    rows = episodes.select("dataset", "episode", "tasks", F.explode("action_config").alias("c"))
    frames = F.col("c.frame_ids")
    rows = rows.filter(F.size(frames) >= 2)
    tokens = (F.get(frames, F.lit(1)) - F.get(frames, F.lit(0))) * per_latent
    latents = F.expr(f"(size(c.frame_ids) - 1) div {per_latent} + 1")
    first = F.get(frames, F.lit(0)).cast("long")
    needed = F.least(F.greatest(F.col("c.end_frame") - first, F.lit(0)), latents * tokens - tokens).cast("long")
    text = F.when(F.coalesce(F.col("c.action_text"), F.lit("")) != "", F.col("c.action_text")).otherwise(F.get("tasks", F.lit(0)))
    return rows.filter(tokens > 0).select("dataset", text.alias("task"), "episode", first.alias("start"), (first + needed).alias("end"))


def support_violations(episodes: DataFrame) -> DataFrame:
    """(dataset, episode, rule): configs whose frames are too few, or don't go forwards."""
    rows = episodes.select("dataset", "episode", F.explode("action_config").alias("c"))
    frames = F.col("c.frame_ids")
    rule = F.when(F.size(frames) == 1, "one_frame").when((F.size(frames) >= 2) & (F.get(frames, F.lit(1)) <= F.get(frames, F.lit(0))), "stride")
    return rows.select("dataset", "episode", rule.alias("rule")).filter("rule is not null")


def support_size(episodes: DataFrame, per_latent: int = 4) -> DataFrame:
    """(dataset, task, episode, support): distinct reachable targets as lengths of interval unions; no target has a row."""
    keys = ["dataset", "task", "episode"]
    return intervals.union_length(support_ranges(episodes, per_latent), keys, keys).withColumnRenamed("length", "support")
