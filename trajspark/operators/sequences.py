"""Per-episode sequence operators: differences, cumulation, anchors, padding, segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars, vectors
from . import order


def _by(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def with_step(df: DataFrame, group: list[str], order: list[str], out: str = "t") -> DataFrame:
    """Gapless step number from 0 within each episode."""
    return df.withColumn(out, (F.row_number().over(_by(group, order)) - 1).cast("long"))


def motion_score(df: DataFrame, action: str, group: list[str], order: list[str], gripper: tuple[int, ...] = (), out: str = "motion") -> DataFrame:
    """Length of the step from the previous action plus twice the gripper channels' moves; 0 for the first row."""
    before = F.lag(action).over(_by(group, order))
    grip = sum((F.abs(F.get(F.col(action), F.lit(g)) - F.get(F.col("__before"), F.lit(g))) for g in gripper), F.lit(0.0))
    return df.withColumn("__before", before).withColumn(
        out, F.coalesce(vectors.distance(action, "__before") + 2 * grip, F.lit(0.0))
    ).drop("__before")


def cumulated(df: DataFrame, x: str, group: list[str], order: list[str], out: str) -> DataFrame:
    whole = _by(group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(x).over(whole))


def anchored(df: DataFrame, x: str, group: list[str], order: list[str], out: str) -> DataFrame:
    """Difference from the episode's first row."""
    return df.withColumn(out, F.col(x) - F.first(x).over(_by(group, order)))


def reanchored(df: DataFrame, position: str, cumulative: str, episode: list[str], segment: str, order: list[str]) -> DataFrame:
    """Segment-local anchors: positions from the segment's first row, cumulated values from the row before it (0 at the episode's start)."""
    before = F.coalesce(F.lag(cumulative).over(_by(episode, order)), F.lit(0.0))
    local = _by([*episode, segment], order)
    return df.withColumn("__before", before).withColumns({
        f"{position}_local": F.col(position) - F.first(position).over(local),
        f"{cumulative}_local": F.col(cumulative) - F.first("__before").over(local),
    }).drop("__before")


def relative_pose(df: DataFrame, xyz: str, quaternion: str, group: list[str], order: list[str]) -> DataFrame:
    """Translation minus the first one, and first rotation inverted times rotation."""
    w = _by(group, order)
    return df.withColumns({"__x": F.first(xyz).over(w), "__q": F.first(quaternion).over(w)}).withColumns({
        f"{xyz}_rel": vectors.minus(xyz, "__x"), f"{quaternion}_rel": vectors.quaternion_product(vectors.quaternion_inverse("__q"), quaternion),
    }).drop("__x", "__q")


def lead_pairs(df: DataFrame, x: str, offset: int, group: list[str], order: list[str], out: str) -> DataFrame:
    """Each row with the value ``offset`` rows ahead; rows without one go."""
    return df.withColumn(out, F.lead(x, offset).over(_by(group, order))).filter(F.col(out).isNotNull())


def progress(df: DataFrame, group: list[str], step: str = "t", out: str = "progress") -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return df.withColumn(out, F.col(step) / F.greatest(n - 1, F.lit(1)))


def aligned_rows(length: Column, block: int = scalars.ACTION_BLOCK) -> Column:
    """Rows that whole blocks cover: block * floor((length - 1) / block), 0 for an empty episode."""
    return F.greatest(F.floor((length - 1) / F.lit(block)) * block, F.lit(0)).cast("long")


def pad_and_trim(df: DataFrame, group: list[str], step: str, value: str, block: int = scalars.ACTION_BLOCK) -> DataFrame:
    """Whole blocks of each episode behind a block of zeros (steps -block to -1); the tail goes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    real = df.withColumn("__rows", aligned_rows(n, block)).filter(F.col(step) < F.col("__rows")).select(*group, step, value)
    lead = df.select(*group).distinct().select(
        *group, F.explode(F.sequence(F.lit(-block).cast("long"), F.lit(-1).cast("long"))).alias(step), F.lit(0.0).alias(value)
    )
    return real.unionByName(lead)


def sampled_frames(length: Column, stride: int = 4) -> Column:
    """0, stride, 2 stride, ..., cropped to 1 + 4k frames."""
    n = F.ceil(length / F.lit(stride)).cast("long")
    usable = F.when(n > 0, 1 + F.floor((n - 1) / F.lit(4)) * 4).otherwise(0)
    return scalars.interval_ids(usable, step=stride)


def latent_frames(sampled: Column) -> Column:
    return (1 + F.floor((sampled - 1) / F.lit(4))).cast("long")


def most_segment_frames(cap: int) -> int:
    """Frames of the longest segment whose rounded token count keeps within the cap."""
    frames = cap // scalars.TOKENS_PER_FRAME
    multiple = scalars.TOKEN_MULTIPLE
    while frames > 0 and -(-frames * scalars.TOKENS_PER_FRAME // multiple) * multiple > cap:
        frames -= 1
    return frames


def plan_segments(episodes: DataFrame, frames: str, cap: int, keys: list[str]) -> DataFrame:
    """Token-bounded segments of latent frames: (ordinal, start, stop, frame_count, token_count).

    A segment holds one boundary frame more than its blocks, the next segment's first.
    """
    most = most_segment_frames(cap)
    if most < 2:
        raise ValueError("the cap holds no block")
    blocks = F.col(frames) - 1
    starts = F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1, F.lit(most - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = episodes.select(*keys, frames, F.posexplode(starts).alias("ordinal", "start"))
    rows = rows.withColumn("stop", F.least(F.col("start") + most - 1, F.col(frames).cast("long") - 1))
    rows = rows.withColumn("frame_count", F.col("stop") - F.col("start") + 1)
    return rows.withColumn("token_count", scalars.episode_tokens("frame_count"))


def contiguity_violations(segments: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Segments that don't start where the one before ends, have a gap in their ordinals, or don't cover their parent."""
    w = Window.partitionBy(*keys).orderBy("ordinal", "start")
    n = Window.partitionBy(*keys)
    rows = segments.withColumns({
        "__next": F.lead("start").over(w), "__row": F.row_number().over(w) - 1, "__first": F.min("start").over(n), "__last": F.max("stop").over(n),
    })
    rules = F.array_compact(F.array(
        F.when(F.col("__next").isNotNull() & (F.col("__next") != F.col("stop")), "gap"),
        F.when(F.col("__row") != F.col("ordinal"), "ordinal"),
        F.when((F.col("__row") == 0) & (F.col("__first") != 0), "start"),
        F.when((F.col("__row") == 0) & (F.col("__last") != F.col(length) - 1), "cover"),
    ))
    return rows.select(*keys, "ordinal", F.explode(rules).alias("rule"))


def frame_offsets(df: DataFrame, length: str, group: list[str], order: list[str]) -> DataFrame:
    """Exclusive running sum of lengths."""
    before = _by(group, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def last_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The n latest rows of each group."""
    latest = Window.partitionBy(*group).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__r", F.row_number().over(latest)).filter(F.col("__r") <= n).drop("__r")


def running_rate(df: DataFrame, hit: Column, group: list[str], order: list[str], out: str = "running_rate") -> DataFrame:
    whole = _by(group, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.avg(hit.cast("double")).over(whole))


def sliding_mean(df: DataFrame, x: str, group: list[str], order: list[str], rows: int, out: str) -> DataFrame:
    return df.withColumn(out, F.avg(x).over(_by(group, order).rowsBetween(-rows, Window.currentRow)))


def adaptive_ensemble(df: DataFrame, vector: str, group: list[str], order: list[str], horizon: int, alpha: float, out: str = "ensemble") -> DataFrame:
    """Mean of the last ``horizon`` vectors with weights softmax(alpha * cosine to the current one)."""
    recent = _by(group, order).rowsBetween(-(horizon - 1), Window.currentRow)
    held = df.withColumn("__held", F.collect_list(vector).over(recent))
    powers = F.transform(F.col("__held"), lambda v: F.exp(alpha * vectors.cosine(v, vector)))
    held = held.withColumn("__w", powers).withColumn("__sum", vectors.total(F.col("__w")))
    mean = F.transform(
        F.sequence(F.lit(0), F.size(vector) - 1),
        lambda k: vectors.total(F.zip_with("__held", "__w", lambda v, w: F.get(v, k).cast("double") * w)) / F.col("__sum"),
    )
    return held.withColumn(out, mean).drop("__held", "__w", "__sum")


def mask_pairs(tokens: DataFrame, window: str = "window") -> DataFrame:
    """Query and key tokens that may see each other: same sequence, frames within the window, and

    clean to clean up to the same frame, noisy to clean before it, noisy to noisy at it.
    The sequence is an equality key, the frames a residual range condition.
    """
    q, k = tokens.alias("q"), tokens.alias("k")
    fq, fk = F.col("q.frame"), F.col("k.frame")
    both = (
        (~F.col("q.noisy") & ~F.col("k.noisy") & (fk <= fq)) | (F.col("q.noisy") & ~F.col("k.noisy") & (fk < fq))
        | (F.col("q.noisy") & F.col("k.noisy") & (fk == fq))
    )
    near = F.abs(fq - fk) <= F.col(f"q.{window}")
    return q.join(k, (F.col("q.seq") == F.col("k.seq")) & (F.col("q.seq") >= 0) & near & both).select(
        F.col("q.seq").alias("seq"), F.col("q.token").alias("q_token"), F.col("k.token").alias("k_token")
    )


def cross_mask_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of tokens of one non-negative sequence id."""
    l, r = left.filter("seq >= 0"), right.filter("seq >= 0")
    return l.select("seq", F.col("token").alias("q_token")).join(r.select("seq", F.col("token").alias("k_token")), "seq")


def standardised(df: DataFrame, x: str, keys: list[str], floor: float = 1e-4) -> DataFrame:
    """(x - mean) / std per channel, population deviation of at least ``floor``."""
    w = Window.partitionBy(*keys)
    return df.withColumns({
        "mean": F.avg(x).over(w), "std": F.greatest(F.stddev_pop(x).over(w), F.lit(floor)),
    }).withColumn(f"{x}_std", (F.col(x) - F.col("mean")) / F.col("std"))


def channel_quantiles(df: DataFrame, vector: str, *group: str) -> DataFrame:
    """Exact q01 and q99 of each channel over finite values; a non-finite value is an error of its channel."""
    rows = df.select(*group, F.posexplode(vector).alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    keys = [*group, "channel"]
    wrong = rows.groupBy(*keys).agg(F.count_if(~scalars.is_finite("x")).alias("non_finite"))
    found = order.group_quantiles(rows, keys, "x", {"q01": 0.01, "q99": 0.99})
    same = reduce(lambda a, b: a & b, [wrong[k].eqNullSafe(found[k]) for k in keys])
    return wrong.join(found, same, "left").select(*[wrong[k] for k in keys], "q01", "q99", "non_finite")


def model_quantiles(quantiles: DataFrame, mapping: dict[int, int], fixed: set[int], size: int) -> DataFrame:
    """Quantiles of ``size`` model channels: mapped ones from the data, fixed and unmapped ones -1 and 1."""
    spark = quantiles.sparkSession
    places = spark.createDataFrame([(to, at, at in fixed) for at, to in sorted(mapping.items())], "model_channel int, channel int, fixed boolean")
    all_ = spark.range(size).select(F.col("id").cast("int").alias("model_channel"))
    joined = all_.join(F.broadcast(places), "model_channel", "left").join(F.broadcast(quantiles), "channel", "left")  # at most ``size`` rows each
    plain = F.col("channel").isNull() | F.col("fixed")
    return joined.select(
        "model_channel", F.when(plain, -1.0).otherwise(F.col("q01")).alias("q01"), F.when(plain, 1.0).otherwise(F.col("q99")).alias("q99")
    )
