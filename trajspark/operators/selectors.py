"""Budgeted segment selection, coverage and budget tables.

Segments have (episode, segment, start, end, first, last): frames [start, end)
and actions first to last, both inclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from . import intervals, order

#: A budget from here on selects everything.
WHOLE = 0.999


def segments_of(episodes: DataFrame, configs: str = "action_config") -> DataFrame:
    """Segments from nested configs; the place in the list is the id where none is given."""
    rows = episodes.select("episode", F.posexplode_outer(configs).alias("place", "c")).filter("c is not null")
    return rows.select(
        "episode", F.coalesce(F.col("c.segment_id"), F.col("place")).alias("segment"), F.col("c.start_frame").alias("start"), F.col("c.end_frame").alias("end"),
        F.coalesce("c.action_loss_first", "c.start_frame").alias("first"), F.coalesce(F.col("c.action_loss_last"), F.col("c.end_frame") - 1).alias("last"),
    )


#: Fixed value: frames from one latent observation to the next.
FRAME_STRIDE = 4


def segment_fields(episodes: DataFrame, configs: str = "action_config") -> DataFrame:
    """Segments of episodes (episode, length, configs) with every field, whether or not the configs have it.

    Without a value the id is the place in the list, actions go from the start
    to the last frame before the end or the episode's own end, frame ids are
    every fourth from the start, and flags are false.
    """
    kind = episodes.schema[configs].dataType.elementType
    own = lambda name: F.col(f"c.{name}") if name in kind.names else F.lit(None)
    rows = episodes.select("episode", "length", F.posexplode(configs).alias("place", "c")).filter("c is not null")
    start, end = F.col("c.start_frame").cast("long"), F.col("c.end_frame").cast("long")
    first = F.coalesce(own("action_loss_first").cast("long"), start)
    last = F.coalesce(own("action_loss_last").cast("long"), F.least(end, F.col("length")) - 1)
    every = F.when(end > start, F.sequence(start, end - 1, F.lit(FRAME_STRIDE).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return rows.select(
        "episode", F.coalesce(own("segment_id").cast("long"), F.col("place").cast("long")).alias("segment"), start.alias("start"), end.alias("end"), first.alias("first"), last.alias("last"),
        F.coalesce(own("frame_ids").cast("array<bigint>"), every).alias("frame_ids"), F.coalesce(own("real_action_count").cast("long"), last - first + 1).alias("real_action_count"),
        *[F.coalesce(own(flag).cast("boolean"), F.lit(False)).alias(flag) for flag in ("contains_pick3_completion", "contains_success_tail")],
    )


def actions(segments: DataFrame, *keep: str) -> DataFrame:
    return segments.filter("last >= first").select("episode", *keep, F.explode(F.sequence("first", "last")).alias("action"))


def target_actions(segments: DataFrame, budget: float) -> DataFrame:
    """One row: the number of distinct actions that the budget asks for, at least one."""
    return actions(segments).distinct().agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * budget)).cast("long").alias("target"))


def greedy_to_budget(ranked: DataFrame, budget: float, segments: DataFrame) -> DataFrame:
    """The shortest prefix by ``rank`` that covers the budget of distinct actions, its last segment included.

    An action counts where it first appears, so the sequential greedy is a
    running sum over one row for each segment, dealt in runs of ranks.
    """
    if budget >= WHOLE:
        return segments
    keys = ["episode", "segment"]
    first = actions(ranked, "rank").groupBy("episode", "action").agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count(F.lit(1)).alias("new"))
    counted = ranked.select(*keys, "rank").join(new, "rank", "left").fillna(0, ["new"])
    counted = order.running_sum(counted, "rank", "new", "covered_before")
    kept = counted.crossJoin(F.broadcast(target_actions(segments, budget))).filter("covered_before < target")
    return segments.join(kept.select(*keys, "rank"), keys)


def ranked(segments: DataFrame, by: list[Column]) -> DataFrame:
    return order.numbered(segments, by, "rank")


def round_robin(segments: DataFrame, within: list[Column]) -> DataFrame:
    """First of each episode, then second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy("episode").orderBy(*within))
    return ranked(segments.withColumn("turn", turn), [F.col("turn"), F.col("episode")])


def uniform_picks(segments: DataFrame, budget: float) -> DataFrame:
    """ceil(n * budget) segments of each episode at even distances (halves to even); the middle one if it's one."""
    w = Window.partitionBy("episode")
    rows = segments.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": F.row_number().over(w.orderBy("segment", "start")) - 1})
    rows = rows.withColumn("__c", F.greatest(F.lit(1), F.ceil(F.col("__n") * budget)).cast("long"))
    picks = rows.select("episode", "__n", "__c").distinct().select(
        "episode", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1)).alias("k"), "__n", "__c"
    )
    even = F.bround(F.col("k") * (F.col("__n") - 1) / F.greatest(F.col("__c") - 1, F.lit(1)), 0).cast("int")
    picks = picks.select("episode", F.col("k").alias("pick"), F.when(F.col("__c") == 1, F.floor(F.col("__n") / 2).cast("int")).otherwise(even).alias("__i"))
    return rows.join(picks, ["episode", "__i"]).drop("__n", "__i", "__c")


def event_scores(segments: DataFrame, episodes: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Segments with event and stage hits and the summed score.

    Keyframes and stage anchors meet segments by episode with a range
    condition; a hit is a flag, however many there are.
    """
    stages = episodes.select("episode", F.explode(F.array(
        F.lit(0).cast("long"), F.floor(F.col("length") / F.lit(3)).cast("long"), F.floor(2 * F.col("length") / F.lit(3)).cast("long"), (F.col("length") - 1).cast("long")
    )).alias("frame"))
    marks = keyframes.select("episode", F.col("frame").cast("long").alias("frame"), F.lit(1).alias("event")).unionByName(stages.withColumn("event", F.lit(0)))
    k = marks.select(F.col("episode").alias("__e"), "frame", "event")
    inside = (F.col("episode") == F.col("__e")) & (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end"))
    hits = segments.select("episode", "segment", "start", "end").join(k, inside).groupBy("episode", "segment").agg(
        F.max(F.col("event") == 1).alias("event_hit"), F.max(F.col("event") == 0).alias("stage_hit")
    )
    rows = segments.join(hits, ["episode", "segment"], "left").fillna(False, ["event_hit", "stage_hit"])
    score = 1000.0 * F.col("event_hit").cast("double") + 100.0 * F.col("stage_hit").cast("double") + F.col("motion_score")
    for flag, value in (("success_tail", 500.0), ("completion", 250.0)):
        if flag in segments.columns:
            score = score + value * F.col(flag).cast("double")
    return rows.withColumn("score", score)


def with_motion(segments: DataFrame, steps: DataFrame) -> DataFrame:
    """Sum of per-step motion over first to last, by running sums: two equality joins, no range join."""
    w = Window.partitionBy("episode").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select("episode", "t", F.sum("motion").over(w).alias("upto"))
    ends = steps.groupBy("episode").agg(F.max("t").alias("__end"))
    rows = segments.join(ends, "episode", "left").withColumns({"__hi": F.least("last", "__end"), "__lo": F.col("first") - 1})
    hi = sums.select("episode", F.col("t").alias("__hi"), F.col("upto").alias("__u"))
    lo = sums.select("episode", F.col("t").alias("__lo"), F.col("upto").alias("__l"))
    joined = rows.join(hi, ["episode", "__hi"], "left").join(lo, ["episode", "__lo"], "left")
    score = F.when(F.col("__hi") < F.col("first"), F.lit(0.0)).otherwise(F.coalesce(F.col("__u"), F.lit(0.0)) - F.coalesce(F.col("__l"), F.lit(0.0)))
    return joined.withColumn("motion_score", score).drop("__hi", "__lo", "__u", "__l", "__end")


def select_full(segments: DataFrame, budget: float, **_) -> DataFrame:
    return segments


def select_motion(segments: DataFrame, budget: float, **_) -> DataFrame:
    return greedy_to_budget(ranked(segments, [F.desc("motion_score"), F.col("episode"), F.col("segment")]), budget, segments)


def select_uniform(segments: DataFrame, budget: float, **_) -> DataFrame:
    if budget >= WHOLE:
        return segments
    return greedy_to_budget(round_robin(uniform_picks(segments, budget), [F.col("pick")]), budget, segments)


def select_random(segments: DataFrame, budget: float, seed: int = 42, **_) -> DataFrame:
    """Hash order within each episode, then round robin: the same at any partitioning."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("episode").cast("string"), F.col("segment").cast("string")))
    return greedy_to_budget(round_robin(segments, [drawn, F.col("segment")]), budget, segments)


def select_events(segments: DataFrame, budget: float, episodes: DataFrame, keyframes: DataFrame, **_) -> DataFrame:
    scored = event_scores(segments, episodes, keyframes)
    return greedy_to_budget(ranked(scored, [F.desc("score"), F.desc("episode"), F.desc("segment")]), budget, segments)


#: The pluggable surface: a selector is a function of segments and a budget.
SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "full": select_full, "random": select_random, "uniform": select_uniform, "motion_gripper": select_motion, "event_stage": select_events,
}


def select(name: str, segments: DataFrame, budget: float, **context) -> DataFrame:
    if name not in SELECTORS:
        raise ValueError(f"unknown selector: {name}")
    if budget < WHOLE and name != "full":
        segments = scratch.materialize(segments, "segments")  # ranked, counted and joined below
    return SELECTORS[name](segments, budget, **context)


def budget_row(chosen: DataFrame, segments: DataFrame, name: str, budget: float, files: DataFrame | None = None) -> DataFrame:
    """Unique actions and observations, exposures, their ratio to the whole, overlap, and what is stored for them.

    Actions are [first, last], observations [start, end], both inclusive;
    unique ones are lengths of interval unions, so that no point has a row.
    ``files`` (episode, segment, camera, bytes) are those of all segments.
    """
    spans = lambda df, low, high: df.select("episode", F.col(low).alias("start"), (F.col(high) + 1).alias("end"))
    length = lambda df, out: intervals.union_length(df, ["episode"], []).select(F.coalesce("length", F.lit(0)).alias(out))
    one = chosen.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias("exposures"))
    parts = [length(spans(chosen, "first", "last"), "unique_actions"), length(spans(segments, "first", "last"), "all_actions"), length(spans(chosen, "start", "end"), "unique_observations")]
    if files is not None:
        stored = files.join(chosen.select("episode", "segment"), ["episode", "segment"], "left_semi")
        parts.append(stored.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")))
    for part in parts:
        one = one.crossJoin(part)  # one row each
    return one.select(
        F.lit(name).alias("selector"), F.lit(budget).alias("budget"), "segments", "unique_actions", "unique_observations", "exposures", "all_actions",
        F.try_divide("unique_actions", "all_actions").alias("action_ratio"), F.try_divide("exposures", "unique_actions").alias("overlap_ratio"),
        *(["files", "bytes"] if files is not None else []),
    )


def coverage(chosen: DataFrame, episodes: DataFrame, bins: int) -> DataFrame:
    """Covered and all actions by normalised time bin, over all episodes; bin edges round halves to even.

    The union of an episode's intervals meets only the bins it touches, and
    overlaps are differences of ends.
    """
    edge = lambda i: F.bround(i * F.col("length") / F.lit(float(bins)), 0).cast("long")
    cells = episodes.select("episode", "length", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    totals = cells.groupBy("bin").agg(F.sum(F.greatest(edge(F.col("bin") + 1) - edge(F.col("bin")), F.lit(0))).alias("total"))
    covered = intervals.islands(chosen.select("episode", F.col("first").alias("start"), (F.col("last") + 1).alias("end")), ["episode"])
    rows = covered.join(episodes.select("episode", "length"), "episode")
    near = lambda x, by: F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.floor(x * bins / F.col("length")) + by).cast("int")))
    touched = F.when(F.col("length") > 0, F.sequence(near(F.col("start"), -1), near(F.col("end"), 1)))
    rows = rows.select("start", "end", "length", F.explode(touched).alias("bin"))
    common = F.least("end", edge(F.col("bin") + 1)) - F.greatest("start", edge(F.col("bin")))
    hit = rows.groupBy("bin").agg(F.sum(F.greatest(common, F.lit(0))).alias("covered"))
    return totals.join(hit, "bin", "left").fillna(0, ["covered"]).select(
        "bin", "covered", "total", (F.col("covered") / F.greatest(F.col("total"), F.lit(1))).alias("coverage_ratio")
    )


def filter_configs(episodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Episodes with only the configs that the manifest names, in their order; emptied episodes go."""
    rows = episodes.select("episode", F.posexplode("action_config").alias("place", "c"))
    keep = manifest.select("episode", F.col("start").alias("__s"), F.col("end").alias("__e")).distinct()
    on = (rows["episode"] == keep["episode"]) & (F.col("c.start_frame") == F.col("__s")) & (F.col("c.end_frame") == F.col("__e"))
    kept = rows.join(keep, on, "left_semi")
    return kept.groupBy("episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda x: x["c"]).alias("action_config"))


def seed_aggregate(results: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one seed), ends and count over seeds."""
    return results.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n")
    )


def sufficient_budget(scores: DataFrame, share: float) -> DataFrame:
    """Least budget whose score reaches the share of the full-data score, by selector."""
    full = scores.filter(F.col("budget") >= WHOLE).groupBy("selector").agg(F.max("score").alias("full"))
    return scores.join(full, "selector").filter(F.col("score") >= share * F.col("full")).groupBy("selector").agg(F.min("budget").alias("budget"))
