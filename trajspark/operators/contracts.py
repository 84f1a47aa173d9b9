"""Contracts that artifacts must meet, reports on runs, and recomputation against what was recorded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from . import diff, order, quality

#: Rows of zeros before a sidecar's real actions, and the width and length step of its rows.
ZERO_PREFIX, ACTION_WIDTH, ALIGNMENT, ANCHOR_WIDTH = 16, 19, 16, 12
#: A latent record's grid of cells, channels, type, video size and the frames of a video to one latent frame.
LATENT_GRID, LATENT_CHANNELS, LATENT_TYPE, VIDEO_SIZE, IMAGE_STRIDE, LATENT_STRIDE = (14, 14), 48, "bfloat16", (224, 224), 4, 4


def field_rules(rows: DataFrame, key: str, expected: dict[str, object]) -> DataFrame:
    """A violation for each field (scalars, lists, nested paths) that differs from its contract; null differs from a value."""

    def wanted(v: object) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    return quality.violations(rows, key, {f"differing_{name.replace('.', '_')}": ~F.col(name).eqNullSafe(wanted(v)) for name, v in expected.items()})


def entry_rules(files: DataFrame, cameras: list[str]) -> DataFrame:
    """Manifest entries (episode_index, camera_key, path, size, frames, sha256): known cameras, safe paths, positive counts, no repeats."""
    by_key, by_path = Window.partitionBy("episode_index", "camera_key"), Window.partitionBy("path")
    rows = files.withColumns({"__k": F.count(F.lit(1)).over(by_key), "__p": F.count(F.lit(1)).over(by_path)})
    return quality.violations(rows, "path", {
        "unknown_camera": ~F.col("camera_key").isin(cameras), "unsafe_path": ~scalars.is_safe_relative_path("path"), "bad_digest": ~scalars.is_sha256("sha256"),
        "empty_file": F.col("size") <= 0, "no_frames": F.col("frames") <= 0, "repeated_key": F.col("__k") > 1, "repeated_path": F.col("__p") > 1,
    })


def real_actions(length: str | Column) -> Column:
    """The longest aligned count of actions that leaves one row over."""
    return F.floor((scalars.c(length) - 1) / F.lit(ALIGNMENT)).cast("long") * ALIGNMENT


def sidecar_facts(sidecars: DataFrame, *kept: str) -> DataFrame:
    """What the rules ask of sidecars, without their arrays: counts, digest and small facts, beside the columns kept.

    ``frame_ids_of`` is the count of real actions that the frame ids are those of, null where they are of none.
    """
    width = lambda r: F.size(r) == ACTION_WIDTH
    finite = lambda a: F.forall(a, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    count = (F.size("source_frame_ids") - ZERO_PREFIX).cast("long")
    ids = F.concat(F.array_repeat(F.lit(-1).cast("long"), ZERO_PREFIX), scalars.interval_ids(count))
    facts = {
        "action_rows": F.size("action"), "action_wide": F.forall("action", width), "action_finite": F.forall("action", finite),
        "mask_rows": F.size("mask"), "mask_wide": F.forall("mask", width), "mask_open": F.forall("mask", lambda m: F.forall(m, lambda v: v)),
        "anchor_whole": (F.size("anchor") == ANCHOR_WIDTH) & finite("anchor"), "frame_ids_of": F.when(F.col("source_frame_ids").eqNullSafe(ids), count),
        "prefix_zero": F.forall(F.slice("action", 1, ZERO_PREFIX), lambda r: F.forall(r, lambda v: v == 0)), "last_channel_zero": F.forall("action", lambda r: F.element_at(r, -1) == 0),
    }
    counts = ("source_length", "real_action_count", "zero_prefix_count", "tail_discarded_count", "source_sha256")
    return sidecars.select(*kept, *counts, *[fact.alias(name) for name, fact in facts.items()])


def fact_rules(facts: DataFrame, key: str) -> DataFrame:
    """:func:`sidecar_facts` against the raw length and digest that the sidecars were made from."""
    real = F.greatest(real_actions("raw_length"), F.lit(0))
    rows, no = real + ZERO_PREFIX, lambda fact: ~F.col(fact)
    return quality.violations(facts, key, {
        "action_shape": (F.col("action_rows") != rows) | no("action_wide"), "mask_shape": (F.col("mask_rows") != rows) | no("mask_wide"), "mask_open": no("mask_open"),
        "action_not_finite": no("action_finite"), "anchor": no("anchor_whole"),
        "source_length": F.col("source_length") != F.col("raw_length"), "real_action_count": F.col("real_action_count") != real,
        "zero_prefix_count": F.col("zero_prefix_count") != ZERO_PREFIX, "tail_discarded_count": F.col("tail_discarded_count") != F.col("raw_length") - real,
        "source_digest": F.col("source_sha256") != F.col("raw_sha256"), "source_frame_ids": ~F.col("frame_ids_of").eqNullSafe(real),
        "prefix_not_zero": no("prefix_zero"), "last_channel_not_zero": no("last_channel_zero"),
    })


def sidecar_rules(sidecars: DataFrame, key: str) -> DataFrame:
    """Action sidecars against the raw length and digest that they were made from; one without violations can be reused."""
    return fact_rules(sidecar_facts(sidecars, key, "raw_length", "raw_sha256"), key)


def latent_rules(records: DataFrame, key: str) -> DataFrame:
    """Latent records against what their episode asks for; a record without violations can be kept on a resume.

    A row has the record's fields (``file`` is null where there is no file) and
    ``want_length``, ``want_task``, ``want_camera``, ``want_frame_ids`` and
    ``want_fps``.  A field that a record lacks (null) differs; a missing file
    is one violation only.
    """
    frames = F.size("want_frame_ids")
    latent = F.floor((frames - 1) / F.lit(LATENT_STRIDE)).cast("int") + 1
    (h, w), (vh, vw) = LATENT_GRID, VIDEO_SIZE
    wanted = {
        "latent_shape": F.array(latent * h * w, F.lit(LATENT_CHANNELS)), "latent_dtype": F.lit(LATENT_TYPE), "latent_num_frames": latent, "latent_height": F.lit(h), "latent_width": F.lit(w),
        "video_num_frames": frames, "source_video_num_frames": F.col("want_length"), "video_height": F.lit(vh), "video_width": F.lit(vw), "text": F.col("want_task"),
        "camera_key": F.col("want_camera"), "frame_ids": F.col("want_frame_ids"), "start_frame": F.lit(0), "end_frame": F.col("want_length"), "fps": F.col("want_fps"),
        "ori_fps": F.col("want_fps"), "image_stride": F.lit(IMAGE_STRIDE), "finite": F.lit(True), "has_text_embedding": F.lit(False),
    }
    there = F.col("file").isNotNull()
    return quality.violations(records, key, {"missing_file": ~there} | {f"differing_{c}": there & ~F.col(c).eqNullSafe(v) for c, v in wanted.items()})


def boundary_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str], first: int = 20) -> DataFrame:
    """For each field how many keys changed it over a boundary, and the first of them in order (a report of ``first`` names)."""
    changed = diff.compare(before, after, [key], fields).filter("status = 'changed'").select(key, F.explode("fields").alias("field"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(key))
    named = changed.withColumn("__r", place).filter(F.col("__r") <= first)
    return changed.groupBy("field").agg(F.count(F.lit(1)).alias("changed")).join(
        named.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("names")), "field"
    )


def signatures(planned: DataFrame, group: list[str], item: str, fields: list[str]) -> DataFrame:
    """One digest for each group (a microbatch): its items in order, as canonical JSON."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(item).alias("k"), F.to_json(F.struct(*sorted(fields))).alias("j"))))
    return planned.groupBy(*group).agg(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(listed, lambda x: x["j"]), ","), F.lit("]")), 256).alias("signature"))


def recomputed(recorded: DataFrame, replayed: DataFrame, group: list[str]) -> DataFrame:
    """Recorded signatures against those of a replay: missing, extra or changed groups; nothing where the replay agrees."""
    return diff.compare(recorded, replayed, group, ["signature"])


def memory_report(shards: DataFrame, summaries: DataFrame, sample_draws: int, optimizer_steps: int, projected_steps: int) -> DataFrame:
    """One row: buffers and host memory at their greatest, bytes written, by occurrence, and projected to a longer run."""
    size = shards.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_lineage_bytes"))
    peaks = summaries.agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("max_buffered_records", "max_pending_records", "peak_host_rss_bytes")],
        F.coalesce(F.sum("flush_s"), F.lit(0.0)).alias("flush_s_rank_sum"),
    )
    total = F.col("total_lineage_bytes").cast("double")
    return size.crossJoin(peaks).withColumns({  # one row each
        "bytes_per_sample_occurrence": F.try_divide(total, F.lit(float(sample_draws))), "projected_lineage_bytes": F.try_divide(total * projected_steps, F.lit(float(optimizer_steps))),
    })


def run_maxima(summaries: DataFrame, figures: list[str]) -> DataFrame:
    """Greatest value of each run figure over the summaries of ranks and attempts; null where none has it."""
    return summaries.agg(*[F.max(f).alias(f) for f in figures])


def packing_metadata(records: DataFrame, key: list[str], per_frame: int, patch: tuple[int, int], action_dim: int) -> tuple[DataFrame, DataFrame]:
    """Items to pack from the records of each sample's cameras (camera, frames, channels, height, width, step), and violations.

    Cameras stand side by side: equal frames, channels and heights, widths add up.
    """
    one = records.groupBy(*key).agg(
        F.min("frames").alias("frame_count"), F.min("channels").alias("channels"), F.min("height").alias("height"), F.sum("width").alias("width"), F.min("step").alias("step"),
        *[F.count_distinct(c).alias(f"__{c}") for c in ("frames", "channels", "height")],
    ).withColumn("sample_key", scalars.sample_key(*key))
    broken = quality.violations(one, "sample_key", {
        **{f"differing_{c}": F.col(f"__{c}") > 1 for c in ("frames", "channels", "height")}, "action_tokens": F.col("step") * 4 != per_frame,
        "patch": (F.pmod("height", F.lit(patch[0])) != 0) | (F.pmod("width", F.lit(patch[1])) != 0),
    })
    kept = one.join(broken.select(F.col("key").alias("sample_key")).distinct(), "sample_key", "left_anti")
    shape = F.concat_ws("x", "channels", "height", "width", F.lit(action_dim), F.lit(per_frame), F.lit(1))
    tokens = scalars.grid_tokens("frame_count", "height", "width", *patch, F.lit(per_frame))
    rows = order.numbered(kept, key, "index").withColumn("index", F.col("index") - 1)
    return rows.select("index", "sample_key", "frame_count", tokens.alias("token_count"), shape.alias("shape_signature")), broken


def output_path_rules(outputs: DataFrame, root: str, protected: list[str]) -> DataFrame:
    """Output paths (name, path) that are repeated, no direct child of the root, or overlap a protected path."""
    copies = F.count(F.lit(1)).over(Window.partitionBy("path"))
    parent = F.regexp_extract("path", r"^(.*)/[^/]+/?$", 1)
    over = [(F.col("path") == p) | F.startswith(F.col("path"), F.lit(p.rstrip("/") + "/")) | F.startswith(F.lit(p), F.concat("path", F.lit("/"))) for p in protected]
    return quality.violations(outputs.withColumn("__n", copies), "name", {
        "repeated": F.col("__n") > 1, "no_direct_child": parent != root.rstrip("/"), "overlaps_protected": reduce(lambda a, b: a | b, over, F.lit(False)),
    })


def setup_rules(setups: DataFrame, requests: DataFrame, files: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Whether artifacts of a setup are those that a request needs, and are still the ones that it recorded.

    ``setups``: setup, output_root, source_root, model_root, selected_episodes,
    selected_episode_count, tasks, task_count, artifacts (a map of names and,
    as ``<kind>_sha256``, digests).  ``requests``: setup, output_root,
    model_root.  ``files``: setup, name, sha256.  ``expected``: the file name
    of each kind.  A setup without a request is not looked at.
    """
    asked = requests.select("setup", F.col("output_root").alias("__output"), F.col("model_root").alias("__model"))
    there = files.groupBy("setup").agg(F.map_from_entries(F.collect_list(F.struct("name", F.lower("sha256")))).alias("__files"))  # a few files a setup
    rows = asked.join(setups.withColumn("__own", F.lit(True)), "setup", "left").join(there, "setup", "left")
    own = F.col("__own").isNotNull()
    inside = lambda a, b: F.startswith(F.concat(F.rtrim(a, F.lit("/")), F.lit("/")), F.concat(F.rtrim(b, F.lit("/")), F.lit("/")))
    out, source = F.col("__output"), F.col("source_root")
    rules = {
        "no_setup": ~own, "other_output": own & ~F.col("output_root").eqNullSafe(out), "overlapping_roots": inside(out, source) | inside(source, out), "other_model": own & ~F.col("model_root").eqNullSafe(F.col("__model")),
        "episode_count": own & ~F.col("selected_episode_count").eqNullSafe(F.size("selected_episodes")), "task_count": own & ~F.col("task_count").eqNullSafe(F.size("tasks")),
        "repeated_episode": F.size(F.array_distinct("selected_episodes")) < F.size("selected_episodes"), "repeated_task": F.size(F.array_distinct("tasks")) < F.size("tasks"),
    }
    for kind, name in expected.items():
        found = F.try_element_at("__files", F.lit(name))
        rules |= {
            f"unexpected_{kind}": own & ~F.try_element_at("artifacts", F.lit(kind)).eqNullSafe(F.lit(name)), f"missing_{kind}": own & found.isNull(),
            f"digest_{kind}": own & found.isNotNull() & ~F.lower(F.try_element_at("artifacts", F.lit(f"{kind}_sha256"))).eqNullSafe(found),
        }
    return quality.violations(rows, "setup", rules)


def identity_digest(*fields: str) -> Column:
    """Digest of a launch's identity: its fields as canonical JSON; a field without a value is left out."""
    return scalars.stable_hash(**{f: F.col(f) for f in fields})


def launch_status(launches: DataFrame, manifests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fingerprint, status) of each launch: 'new' where no manifest has its key, 'same' where the manifest was written for this identity, else 'different'."""
    own = launches.withColumn("fingerprint", identity_digest(*fields)).select(key, "fingerprint")
    known = manifests.select(key, F.lower("identity_sha256").alias("__recorded"), F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "new").when(F.col("__recorded").eqNullSafe(F.col("fingerprint")), "same").otherwise("different")
    return own.join(known, key, "left").select(key, "fingerprint", status.alias("status"))


def resume_rules(saved: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Whether runs can go on from saved states: the dataset's fingerprint and the topology (``fields``) must be those of the state.

    A field that an old state doesn't have (null) differs from any value; runs
    without a state, states of no run and repeated states are faults of their own.
    """
    s = saved.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(*fields)).alias("s"))
    both = s.join(current.select(key, F.struct(*fields).alias("c")), key, "full_outer")
    matched = F.col("s").isNotNull() & F.col("c").isNotNull()
    return quality.violations(both, key, {
        "no_state": F.col("s").isNull(), "no_run": F.col("c").isNull(), "repeated_state": F.col("__n") > 1,
        **{f"differing_{f}": matched & ~F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}")) for f in fields},
    })


def mesh_ids(spark: SparkSession, f: int, h: int, w: int, t: int, f_weight: int = 1, f_shift: int = 0, action: bool = False) -> DataFrame:
    """(place, f, h, w, t) of a grid; action rows lie between frames and have -1 for height and width."""
    places = spark.range(f * h * w).withColumnRenamed("id", "place")
    at = {"f": F.expr(f"place div {h * w} + {f_shift}") * f_weight, "h": F.expr(f"place div {w} % {h}"), "w": F.expr(f"place % {w}")}
    rows = places.select("place", *[c.cast("double").alias(k) for k, c in at.items()])
    if action:
        rows = rows.withColumns({"f": F.col("f") + (F.col("h") + 1) / F.lit(h + 1.0), "h": F.lit(-1.0), "w": F.lit(-1.0)})
    return rows.withColumn("t", F.lit(float(t)))
