"""The contract of a segment overlay: geometry, tiling of the parents, totals and the statistics made for it.

All rules give rows (key, rule) and none stops another: whoever loads an
overlay sees every fault at once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import intervals, quality, sequences

#: Action rows of a block, rows of zeros before a segment's actions, widths of its anchors.
ROWS_PER_BLOCK, ZERO_PREFIX, JOINT_ANCHOR, BASE_ANCHOR = 16, 16, 12, 3


class Policy(NamedTuple):
    """What a manifest and its statistics must agree on."""

    version: str
    max_self_tokens: int
    root: str = "root"

    @property
    def max_segment_frames(self) -> int:
        return sequences.most_segment_frames(self.max_self_tokens)


def sample_key(policy: Policy) -> Column:
    return F.concat_ws("|", F.lit(policy.root), F.col("episode_index").cast("string"), F.lit("segment"), F.col("segment_ordinal").cast("string"),
                       F.col("real_block_start").cast("string"), F.col("real_block_end").cast("string"), F.lit(policy.version))


def geometry_rules(segments: DataFrame, policy: Policy) -> DataFrame:
    """Each segment by itself: bounds, what follows from them, budgets, anchors, digest and key."""
    start, end, frames = F.col("real_block_start"), F.col("real_block_end"), F.col("frame_count")
    finite = lambda a, n: (F.size(a) != n) | F.exists(a, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return quality.violations(segments, "segment_index", {
        "bounds": ~((start >= 0) & (start < end)), "ordinal_negative": F.col("segment_ordinal") < 0, "blocks_over_budget": end - start > policy.max_segment_frames - 1,
        "latent_bounds": (F.col("latent_start") != start) | (F.col("latent_stop") != end + 1), "frame_count": frames != end - start + 1,
        "action_rows": (F.col("real_action_row_start") != start * ROWS_PER_BLOCK) | (F.col("real_action_row_end") != end * ROWS_PER_BLOCK),
        "token_count": F.col("token_count") != scalars.episode_tokens("frame_count"), "tokens_over_budget": F.col("token_count") > policy.max_self_tokens,
        "joint_anchor": finite("segment_joint_anchor", JOINT_ANCHOR), "base_anchor": finite("segment_base_anchor", BASE_ANCHOR),
        "action_digest": ~scalars.is_sha256("segment_action_sha256"), "sample_key": F.col("sample_key") != sample_key(policy),
    })


def order_rules(segments: DataFrame) -> DataFrame:
    """Segment numbers and keys don't repeat; ordinals count from 0 in the order of the blocks. By equality joins, without a window."""
    repeats = [quality.violations(segments.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, {f"repeated_{c}": F.col("n") > 1}) for c in ("segment_index", "sample_key")]
    counted = segments.groupBy("episode_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("segment_ordinal").alias("d"), F.min("segment_ordinal").alias("low"), F.max("segment_ordinal").alias("high"))
    dense = quality.violations(counted, "episode_index", {"ordinals_not_dense": (F.col("d") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1)})
    after = segments.select("episode_index", (F.col("segment_ordinal") - 1).alias("segment_ordinal"), F.col("real_block_start").alias("next_start"))
    pairs = segments.join(after, ["episode_index", "segment_ordinal"])
    return quality.union(*repeats, dense, quality.violations(pairs, "segment_index", {"next_starts_elsewhere": F.col("next_start") != F.col("real_block_end")}))


def tiling_rules(segments: DataFrame, parents: DataFrame) -> DataFrame:
    """Blocks of every parent are covered exactly once: gaps, overlaps and blocks outside as ``episode:start-end``; parents without a segment."""
    blocks = parents.select("episode_index", (F.col("latent_frames") - 1).alias("blocks"))
    wrong = intervals.tiling_faults(segments, blocks, ["episode_index"], "blocks", "real_block_start", "real_block_end")
    places = wrong.select(F.concat("episode_index", F.lit(":"), "start", F.lit("-"), "end").alias("key"), F.col("fault").alias("rule"))
    bare = parents.join(segments.select("episode_index").distinct(), "episode_index", "left_anti")
    unknown = segments.select("episode_index").distinct().join(parents, "episode_index", "left_anti")
    return quality.union(
        places, quality.violations(bare, "episode_index", {"parent_without_segment": F.lit(True)}), quality.violations(unknown, "episode_index", {"unknown_parent": F.lit(True)}))


def totals(segments: DataFrame, parents: DataFrame) -> DataFrame:
    """(name, value): what manifest, statistics and audit marker must all have recorded."""
    by_parent = segments.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_count").alias("frames"), F.sum("token_count").alias("tokens"))
    s = by_parent.agg(F.count(F.lit(1)).alias("parent_episodes"), F.count_if(F.col("n") > 1).alias("split_episodes"), F.sum("n").alias("segments"),
                      F.sum("frames").alias("virtual_segment_frames"), F.sum("tokens").alias("total_padded_self_tokens"))
    kept = parents.join(by_parent, "episode_index", "left_semi")
    p = kept.agg(F.sum("latent_frames").alias("source_latent_frames"), F.sum((F.col("latent_frames") - 1) * ROWS_PER_BLOCK).alias("real_action_rows"))
    one = s.crossJoin(p).withColumn("zero_prefix_rows", F.col("segments") * ZERO_PREFIX)  # one row each
    one = one.withColumn("training_action_rows", F.col("real_action_rows") + F.col("zero_prefix_rows"))
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in one.columns])
    return one.select(F.explode(entries).alias("e")).select("e.*")


def totals_rules(recorded: DataFrame, segments: DataFrame, parents: DataFrame) -> DataFrame:
    """Recorded totals (source, name, value) of each source against those that the overlay has; missing ones too."""
    found = totals(segments, parents).select("name", F.col("value").alias("__found"))
    sources = recorded.select("source").distinct()
    wanted = sources.crossJoin(found)  # a few sources, nine totals
    both = wanted.join(recorded, ["source", "name"], "left").withColumn("key", F.concat_ws(":", "source", "name"))
    return quality.violations(both, "key", {"total": ~F.col("value").eqNullSafe(F.col("__found"))})


def statistics_rules(statistics: DataFrame, expected: dict[str, object], channels: DataFrame, size: int, mapped: list[int]) -> DataFrame:
    """The statistics' header fields, and its channels (channel, q01, q99, used): all there, finite, ordered, and used as mapped."""
    from . import contracts

    header = contracts.field_rules(statistics.withColumn("__k", F.lit("statistics")), "__k", expected)
    all_ = statistics.sparkSession.range(size).select(F.col("id").cast("int").alias("channel"))
    both = all_.join(channels, "channel", "full_outer")
    known = F.col("q01").isNotNull() & F.col("q99").isNotNull()
    finite = scalars.is_finite("q01") & scalars.is_finite("q99")
    found = quality.violations(both, "channel", {
        "channel_missing": ~known & (F.col("channel") < size), "channel_unknown": (F.col("channel") >= size) | (F.col("channel") < 0),
        "not_finite": known & ~finite, "quantiles_crossed": finite & (F.col("q01") > F.col("q99")),
        "used_differs": ~F.col("used").eqNullSafe(F.col("channel").isin(mapped)) & known,
    })
    return header.unionByName(found)


def overlay_rules(segments: DataFrame, parents: DataFrame, recorded: DataFrame, policy: Policy) -> DataFrame:
    """Geometry, order, tiling and totals of an overlay in one list of faults."""
    return quality.union(geometry_rules(segments, policy), order_rules(segments), tiling_rules(segments, parents), totals_rules(recorded, segments, parents))
