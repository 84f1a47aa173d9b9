"""Resource cards: support, exposure, replay, quantiles and effective support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage

QUANTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}

#: The metrics of a card with their provenance and unit.
CARD = {
    "sample_draws": ("exact", "sample occurrences"),
    "optimizer_steps": ("exact", "optimizer updates"),
    "U_eligible": ("analytical", "canonical action targets"),
    "U_seen": ("exact", "canonical action targets"),
    "E_action_unweighted": ("exact", "target exposures"),
    "E_action_weighted": ("exact", "loss-weighted target exposures"),
    "mean_replay": ("exact", "weighted exposures per seen target"),
    "mean_replay_unweighted": ("exact", "unweighted exposures per seen target"),
    "exposure_p10": ("exact", "weighted exposures"),
    "exposure_p50": ("exact", "weighted exposures"),
    "exposure_p90": ("exact", "weighted exposures"),
    "exposure_p99": ("exact", "weighted exposures"),
    "N_eff": ("exact", "canonical action targets"),
    "N_eff/U_seen": ("exact", None),
    "zero_exposure_fraction_eligible": ("exact", None),
    "padding_target_slots": ("exact", "target slots"),
    "invalid_or_zero_weight_slots": ("exact", "target slots"),
    "training_wall_clock": ("exact", "seconds"),
    "training_GPU_hours": ("analytical", "GPU-hours"),
    "valid_targets_per_second": ("exact", "unweighted valid real targets/s"),
    "peak_VRAM": ("exact", "bytes"),
}


def effective_support(x: str | Column) -> Column:
    """(sum x)^2 / sum x^2, an aggregate; 0 if the denominator is not positive."""
    v = F.col(x) if isinstance(x, str) else x
    squares = F.sum(v * v)
    return F.when(squares > 0, F.pow(F.sum(v), F.lit(2)) / squares).otherwise(F.lit(0.0))


def exact_quantiles(x: str | Column, empty: float = 0.0) -> dict[str, Column]:
    """Linear-interpolated quantiles as aggregates, ``empty`` where there is no value."""
    v = F.col(x) if isinstance(x, str) else x
    return {name: F.coalesce(F.percentile(v, F.lit(q)), F.lit(empty)) for name, q in QUANTILES.items()}


def replay_entropy(x: str | Column) -> Column:
    """-sum p ln p of shares p = x / sum x, from sums of one pass."""
    v = F.col(x) if isinstance(x, str) else x
    return F.log(F.sum(v)) - F.sum(v * F.log(v)) / F.sum(v)


def zero_fraction(support: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the support never seen; null for an empty support."""
    flags = support.select(*keys).distinct().join(seen.select(*keys, F.lit(1).alias("hit")).distinct(), keys, "left")
    return flags.agg(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)).alias("zero_fraction"))


def slot_cells(slots: DataFrame, group: list[str]) -> DataFrame:
    """Committed slots by target, all in one shuffle: exposures of effective ones, and counts of the others under null targets."""
    hit = lineage.is_effective()
    keys = [F.col(g).alias(f"__{g}") for g in group] + [F.when(hit, F.col(t)).alias(t) for t in lineage.TARGET]
    return lineage.committed(slots).groupBy(*keys).agg(
        F.sum(F.when(hit, F.col("weight")).otherwise(0.0)).alias("exposure_weighted"), F.count_if(hit).alias("exposure_unweighted"),
        F.count_if(lineage.is_padding()).alias("padding_slots"), F.count_if(~lineage.is_padding() & ~hit).alias("invalid_slots"),
    )


def card_row(
    records: DataFrame, slots: DataFrame, eligible: DataFrame | None = None, group: list[str] | None = None,
    wall_clock_s: float | None = None, world_size: int | None = None, peak_vram: int | None = None,
) -> DataFrame:
    """One wide row of metrics for each group, counted for that group alone.

    Draws and steps come from the records, before arrays are exploded, so a
    record without targets still counts.
    """
    group = group or []
    done = lineage.committed(records)
    draws = done.groupBy(*group).agg(F.count(F.lit(1)).alias("sample_draws"), F.count_distinct("optimizer_step").alias("optimizer_steps"))
    cells = slot_cells(slots, group)
    seen = cells.filter("exposure_unweighted > 0")
    weighted = F.when(F.col("exposure_unweighted") > 0, F.col("exposure_weighted"))
    support = cells.groupBy(*[F.col(f"__{g}").alias(g) for g in group]).agg(
        F.count_if(F.col("exposure_unweighted") > 0).alias("U_seen"), F.sum("exposure_unweighted").alias("E_action_unweighted"),
        F.sum("exposure_weighted").alias("E_action_weighted"), effective_support(weighted).alias("N_eff"),
        *[v.alias(f"exposure_{k}") for k, v in exact_quantiles(weighted).items()],
        F.sum("padding_slots").alias("padding_slots"), F.sum("invalid_slots").alias("invalid_slots"),
    )
    if group:
        row = draws.join(support, group, "left")
    else:
        row = draws.crossJoin(support)  # one row each
    if eligible is not None and not group:
        row = row.crossJoin(eligible.agg(F.count_distinct(*lineage.TARGET).alias("U_eligible")))
        row = row.crossJoin(zero_fraction(eligible, seen, lineage.TARGET).withColumnRenamed("zero_fraction", "zero_exposure_fraction_eligible"))
    else:
        row = row.withColumns({"U_eligible": F.lit(None).cast("long"), "zero_exposure_fraction_eligible": F.lit(None).cast("double")})

    def per_seen(x: str) -> Column:
        return F.when(F.col("U_seen") > 0, F.col(x) / F.col("U_seen")).otherwise(F.lit(0.0))

    wall = F.lit(wall_clock_s).cast("double")
    return row.fillna(0, ["U_seen", "E_action_unweighted", "E_action_weighted", "N_eff", "padding_slots", "invalid_slots"]).withColumns({
        "mean_replay": per_seen("E_action_weighted"), "mean_replay_unweighted": per_seen("E_action_unweighted"),
        "N_eff/U_seen": per_seen("N_eff"), "padding_target_slots": F.col("padding_slots"),
        "invalid_or_zero_weight_slots": F.col("invalid_slots"), "training_wall_clock": wall,
        "training_GPU_hours": wall * F.lit(world_size).cast("double") / 3600.0,
        "valid_targets_per_second": F.try_divide(F.col("E_action_unweighted").cast("double"), wall), "peak_VRAM": F.lit(peak_vram).cast("double"),
    })


def long_card(row: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., metric, value, source, unit): a metric without a value is 'unavailable'."""
    group = group or []
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value"), F.lit(s).alias("source"), F.lit(u).cast("string").alias("unit"))
        for m, (s, u) in CARD.items()
    ])
    flat = row.select(*group, F.explode(entries).alias("e")).select(*group, "e.*")
    return flat.withColumn("source", F.when(F.col("value").isNull(), "unavailable").otherwise(F.col("source")))


def resource_card(records: DataFrame, slots: DataFrame, eligible: DataFrame | None = None, group: list[str] | None = None, **run) -> DataFrame:
    return long_card(card_row(records, slots, eligible, group, **run), group)


def metric_values(card: DataFrame, metrics: list[str]) -> DataFrame:
    return card.filter(F.col("metric").isin(metrics))


def rename_metrics(card: DataFrame, names: dict[str, str]) -> DataFrame:
    """Metrics under their newer names, others unchanged."""
    table = card.sparkSession.createDataFrame(sorted(names.items()), "metric string, __new string")
    return card.join(F.broadcast(table), "metric", "left").withColumn("metric", F.coalesce("__new", "metric")).drop("__new")


def merge_moments(parts: DataFrame, *group: str) -> DataFrame:
    """Count, mean and population deviation of a whole from those of its parts (n, mean, std)."""
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    q = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean")))
    return parts.groupBy(*group).agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(q / n - F.pow(s / n, F.lit(2)), F.lit(0.0))).alias("std"))


def moments(df: DataFrame, x: str, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"), F.max(x).alias("most")
    )


def wilson_interval(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson score interval."""
    p = successes / trials
    centre = p + z * z / (2 * trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    scale = 1 + z * z / trials
    return (centre - half) / scale, (centre + half) / scale
