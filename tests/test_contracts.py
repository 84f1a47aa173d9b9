"""Intervals, nearest values, quantiles with ties, overlay contracts, audits and rotations against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import vectors
from trajspark.operators import audit, intervals, lineage, order, overlay, selectors, sequences

SPANS = "k string, start long, end long"


def spans(seed, n=200, keys="aabc"):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(60)
        out.append((rng.choice([*keys, None]), a, a + rng.choice([-2, 0, 1, 3, 9])))
    return out


def covered(rows):
    depth = {}
    for k, a, b in rows:
        for x in range(a, b):
            depth[k, x] = depth.get((k, x), 0) + 1
    return depth


@pytest.mark.parametrize("bucket", [5, 100_000])
def test_islands_are_the_unions(spark, monkeypatch, bucket):
    monkeypatch.setattr(order, "PER_BUCKET", bucket)
    rows = spans(1, 60) + [("a", 100, 200), ("a", 200, 300), ("a", 120, 130), ("a", 100, 200)]
    frame = spark.createDataFrame(rows, SPANS).repartition(5)
    found = intervals.islands(frame, ["k"]).collect()
    depth = covered(rows)
    points = [(r["k"], x) for r in found for x in range(r["start"], r["end"])]
    assert len(points) == len(set(points)) and set(points) == set(depth)
    ends = {(r["k"], r["end"]) for r in found}
    assert not any((r["k"], r["start"]) in ends for r in found)  # none touch
    lengths = {r["k"]: r["length"] for r in intervals.union_length(frame, ["k"], ["k"]).collect()}
    assert lengths == {k: sum(1 for j, _ in depth if j == k) for k in {j for j, _ in depth}}
    assert intervals.islands(spark.createDataFrame([], SPANS), ["k"]).count() == 0


def test_tiling_faults(spark):
    parents = [("a", 10), ("b", 10), ("c", 10), ("d", 4), ("none", 3)]
    rows = [("a", 0, 4), ("a", 4, 10), ("b", 0, 5), ("b", 4, 8), ("c", 2, 6), ("c", 6, 13), ("d", 0, 4), ("d", 0, 4), ("d", 1, 2), ("x", 0, 2), ("c", 3, 3)]
    found = intervals.tiling_faults(spark.createDataFrame(rows, SPANS), spark.createDataFrame(parents, "k string, n long"), ["k"], "n")
    assert sorted(map(tuple, found.collect())) == sorted([
        ("b", 4, 5, "overlap", 1), ("b", 8, 10, "gap", 1), ("c", 0, 2, "gap", 1), ("c", 10, 13, "outside", 1), ("d", 0, 1, "overlap", 1), ("d", 1, 2, "overlap", 2),
        ("d", 2, 4, "overlap", 1), ("none", 0, 3, "gap", 1), ("x", 0, 2, "outside", 1)])


@pytest.mark.parametrize("ties", ["low", "high"])
def test_nearest_value(spark, monkeypatch, ties):
    monkeypatch.setattr(order, "PER_BUCKET", 16)
    rng = random.Random(3)
    values = [(rng.randrange(-20, 60) / 2, i) for i in range(40)] + [(None, 99)]
    asked = [(i, rng.choice([None, rng.randrange(-100, 200) / 4, 7.0])) for i in range(150)]
    found = intervals.nearest(spark.createDataFrame(asked, "q long, x double").repartition(4), spark.createDataFrame(values, "v double, step long"), "x", "v", ["v", "step"], ties)
    known = [v for v in values if v[0] is not None]
    best = lambda x: min(known, key=lambda v: (abs(v[0] - x), v[0] if ties == "low" else -v[0], v[1]))
    got = {r["q"]: (r["v"], r["step"]) for r in found.collect()}
    assert got == {q: best(x) if x is not None else (None, None) for q, x in asked}
    none = intervals.nearest(spark.createDataFrame(asked, "q long, x double"), spark.createDataFrame([], "v double, step long"), "x", "v", ["step"])
    assert none.count() == len(asked) and none.filter("step is not null").count() == 0


@pytest.mark.parametrize("few", [0, 100_000])
def test_quantiles_of_groups_with_ties(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW_VALUES", few)
    monkeypatch.setattr(order, "PER_BUCKET", 50)
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([1.0, 1.0, 1.0, 1.0, rng.random(), None])) for _ in range(400)] + [(None, 3.0), ("one", 2.0)]
    shares = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p97": 0.97, "p100": 1.0}
    frame = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for r in order.group_quantiles(frame, ["g"], "v", shares).collect():
        own = [v for g, v in rows if g == r["g"] and v is not None]
        assert [r[s] for s in shares] == pytest.approx([np.quantile(own, q) for q in shares.values()])
    whole = order.quantiles(frame, "v", shares).first()
    assert [whole[s] for s in shares] == pytest.approx([np.quantile([v for _, v in rows if v is not None], q) for q in shares.values()])
    assert order.quantiles(frame.limit(0), "v", shares, -1.0).first()["p50"] == -1.0


def test_budgets_and_coverage_by_intervals(spark):
    rng = random.Random(6)
    rows = []
    for e in range(4):
        for s in range(6):
            a = rng.randrange(30)
            rows.append((e, s, a, a + rng.randrange(1, 8), a, a + rng.randrange(0, 7)))
    frame = spark.createDataFrame(rows, "episode long, segment long, start long, end long, first long, last long")
    files = spark.createDataFrame([(e, s, c, 10 * s + c) for e, s, *_ in rows for c in (0, 1) if (s, c) != (5, 1)], "episode long, segment long, camera int, bytes long")
    chosen = [r for r in rows if r[1] % 2]
    row = selectors.budget_row(frame.filter("segment % 2 = 1"), frame, "x", 0.5, files).first()
    actions = {(r[0], t) for r in chosen for t in range(r[4], r[5] + 1)}
    assert row["unique_actions"] == len(actions) and row["unique_observations"] == len({(r[0], t) for r in chosen for t in range(r[2], r[3] + 1)})
    assert row["exposures"] == sum(r[5] - r[4] + 1 for r in chosen) and row["all_actions"] == len({(r[0], t) for r in rows for t in range(r[4], r[5] + 1)})
    assert (row["files"], row["bytes"]) == (sum(2 - (r[1] == 5) for r in chosen), sum(20 * r[1] + 1 - (51 if r[1] == 5 else 0) for r in chosen))
    empty = selectors.budget_row(frame.limit(0), frame, "x", 0.1, files).first()
    assert (empty["unique_actions"], empty["exposures"], empty["files"], empty["bytes"]) == (0, 0, 0, 0)
    episodes = spark.createDataFrame([(e, 40 + e) for e in range(5)] + [(9, 0)], "episode long, length long")
    edges = lambda n, b: round(b * n / 7)  # noqa: E731  (halves to even)
    for r in selectors.coverage(frame.filter("segment % 2 = 1"), episodes, 7).collect():
        inside = lambda n: range(edges(n, r["bin"]), edges(n, r["bin"] + 1))
        assert r["total"] == sum(len(inside(40 + e)) for e in range(5)) and r["covered"] == sum((e, t) in actions for e in range(5) for t in inside(40 + e))


def test_reach_of_nested_configs(spark):
    kind = "dataset string, episode long, tasks array<string>, action_config array<struct<start_frame: long, end_frame: long, action_text: string, frame_ids: array<long>>>"
    configs = [
        (0, 40, None, list(range(0, 40, 2))), (10, 60, None, list(range(12, 60, 2))), (0, 30, "other", list(range(0, 30))), (5, 9, None, []), (5, 9, None, [5]), (5, 9, None, [7, 7]), (50, 52, "", [51, 52, 53, 54, 55]),
    ]
    frame = spark.createDataFrame([("d", 1, ["first", "x"], configs), ("d", 2, ["first"], configs[:1]), ("d", 3, ["first"], [])], kind)
    reached = set()
    for e, own in ((1, configs), (2, configs[:1])):
        for start, end, text, frames in own:
            if len(frames) < 2 or frames[1] <= frames[0]:
                continue
            tokens = (frames[1] - frames[0]) * 4
            needed = ((len(frames) - 1) // 4 + 1) * tokens - tokens
            reached |= {(text or "first", e, t) for t in range(frames[0], frames[0] + min(max(end - frames[0], 0), needed))}
    expected = {}
    for task, e, _ in reached:
        expected["d", task, e] = expected.get(("d", task, e), 0) + 1
    assert {(r["dataset"], r["task"], r["episode"]): r["support"] for r in lineage.support_size(frame).collect()} == expected
    assert sorted(map(tuple, lineage.support_violations(frame).collect())) == [("d", 1, "one_frame"), ("d", 1, "stride")]


def good_overlay(spark):
    policy = overlay.Policy("v", 4096)
    parents = spark.createDataFrame([(1, 20), (2, 9), (3, 2)], "episode_index long, latent_frames long")
    rows = sequences.plan_segments(parents, "latent_frames", 4096, ["episode_index"]).select(
        "episode_index", F.col("ordinal").alias("segment_ordinal"), F.col("start").alias("real_block_start"), F.col("stop").alias("real_block_end"), "frame_count", "token_count",
        F.col("start").alias("latent_start"), (F.col("stop") + 1).alias("latent_stop"), (F.col("start") * 16).alias("real_action_row_start"), (F.col("stop") * 16).alias("real_action_row_end"),
        F.array_repeat(F.lit(0.0), 12).alias("segment_joint_anchor"), F.array_repeat(F.lit(0.0), 3).alias("segment_base_anchor"), F.sha2(F.lit("x"), 256).alias("segment_action_sha256"),
        (F.col("episode_index") * 10 + F.col("ordinal")).alias("segment_index"))
    return rows.withColumn("sample_key", overlay.sample_key(policy)), parents, policy


def test_overlay_faults(spark):
    segments, parents, policy = good_overlay(spark)
    found = overlay.totals(segments, parents)
    recorded = found.select(F.lit("marker").alias("source"), "*")
    rules = lambda s, p=parents, r=recorded: {(x["key"], x["rule"]) for x in overlay.overlay_rules(s, p, r, policy).collect()}
    assert {r["name"]: r["value"] for r in found.collect()} == {
        "parent_episodes": 3, "split_episodes": 1, "segments": 5, "source_latent_frames": 31, "virtual_segment_frames": 33, "real_action_rows": 448, "zero_prefix_rows": 80,
        "training_action_rows": 528, "total_padded_self_tokens": 2 * 3840 + 3840 + 4 * 424 // 128 * 128 + (4 * 424 % 128 > 0) * 128 + 896}
    assert rules(segments) == set()
    change = lambda c, at, value: segments.withColumn(c, F.when(F.col("segment_index") == at, value).otherwise(F.col(c)))
    faults = [
        ("latent_stop", 10, F.lit(99), "latent_bounds"), ("frame_count", 10, F.lit(1), "frame_count"), ("real_action_row_end", 11, F.lit(0), "action_rows"), ("token_count", 11, F.lit(5000), "tokens_over_budget"),
        ("segment_joint_anchor", 12, F.array(F.lit(1.0)), "joint_anchor"), ("segment_base_anchor", 12, F.array(F.lit(0.0), F.lit(None), F.lit(0.0)), "base_anchor"),
        ("segment_action_sha256", 20, F.lit("xyz"), "action_digest"), ("sample_key", 20, F.lit("?"), "sample_key"), ("segment_ordinal", 30, F.lit(-1), "ordinal_negative"),
    ]
    wrong = segments
    for column, at, value, _ in faults:
        wrong = wrong.withColumn(column, F.when(F.col("segment_index") == at, value).otherwise(F.col(column)))
    assert rules(wrong) >= {(str(at), rule) for _, at, _, rule in faults}
    assert rules(segments.filter("segment_index <> 11")) >= {("1:8-16", "gap"), ("1", "ordinals_not_dense"), ("marker:segments", "total")}
    assert rules(change("real_block_end", 11, F.lit(18))) >= {("1:16-18", "overlap"), ("11", "blocks_over_budget"), ("11", "next_starts_elsewhere")}
    assert rules(change("real_block_end", 12, F.lit(21))) >= {("1:19-21", "outside")}
    assert rules(segments, parents.union(spark.createDataFrame([(7, 5)], parents.schema))) == {("7:0-4", "gap"), ("7", "parent_without_segment")}
    assert rules(segments, parents.filter("episode_index < 3")) >= {("3", "unknown_parent"), ("3:0-1", "outside")}
    assert rules(segments.union(segments.filter("segment_index = 30"))) >= {("30", "repeated_segment_index"), ("3:0-1", "overlap")}
    assert rules(segments, r=recorded.filter("name <> 'segments'")) == {("marker:segments", "total")}


def test_statistics_contract(spark):
    header = spark.createDataFrame([("2", 19)], "version string, width int")
    channels = [(0, 0.0, 1.0, True), (1, 2.0, 1.0, False), (2, float("nan"), 1.0, False), (4, 0.0, 1.0, True)]
    found = overlay.statistics_rules(header, {"version": "1", "width": 19}, spark.createDataFrame(channels, "channel int, q01 double, q99 double, used boolean"), 4, [0, 1])
    assert sorted(map(tuple, found.collect())) == [("1", "quantiles_crossed"), ("1", "used_differs"), ("2", "not_finite"), ("3", "channel_missing"), ("4", "channel_unknown"), ("4", "used_differs"), ("statistics", "differing_version")]


def test_audit_keeps_all_differences(spark):
    raw = spark.createDataFrame([(e, float(i % 7), i) for e in range(3) for i in range(20 + e)] + [(1, None, 5), (1, float("inf"), 6)], "episode long, x double, n long")
    side, stat = audit.sidecars(raw, "episode", ["n"], ["episode", "n"]), audit.statistics(raw, ["x"])
    levels = lambda s, t: [audit.Level("side", s, side, ["episode"], ["rows", "checksum", "n_max"]), audit.Level("stat", t, stat, ["channel"], ["n", "mean", "high"], {"mean": 1e-6})]
    assert audit.audit(levels(side, stat)).count() == 0
    shuffled = audit.sidecars(raw.orderBy(F.rand(1)), "episode", ["n"], ["episode", "n"])
    assert audit.audit(levels(shuffled, stat)).count() == 0  # the checksum is of rows in any order
    wrong = side.withColumn("rows", F.col("rows") + (F.col("episode") == 0).cast("int")).filter("episode <> 1").union(side.limit(1).withColumn("episode", F.lit(8).cast("long")))
    found = audit.audit(levels(wrong, stat.withColumns({"mean": F.col("mean") * (1 + 1e-9), "high": F.lit(None).cast("double")})))
    assert {(r["level"], r["key"], r["field"]) for r in found.collect()} == {("side", "0", "rows"), ("side", "1", "missing"), ("side", "8", "unknown"), ("stat", "x", "high")}
    passed = audit.verdict(found, ["side", "stat", "totals"]).orderBy("below", "level").collect()
    assert [(r["level"], r["errors"], r["below"], r["passed"]) for r in passed] == [("side", 3, 0, False), ("stat", 1, 3, False), ("totals", 0, 4, True)]
    finite = [i % 7 for e in range(3) for i in range(20 + e)]
    one = stat.first()
    assert (one["n"], one["not_finite"]) == (len(finite), 2) and (one["mean"], one["high"]) == pytest.approx((np.mean(finite), np.quantile(finite, 0.99)))


def elementary(axis, a):
    m, (i, j) = np.eye(3), [(1, 2), (2, 0), (0, 1)][axis]
    m[i, i] = m[j, j] = math.cos(a)
    m[i, j], m[j, i] = -math.sin(a), math.sin(a)
    return m


def test_all_conventions_against_matrices(spark):
    rng = random.Random(1)
    turns = [[rng.uniform(-3, 3), rng.uniform(-1.5, 1.5), rng.uniform(-3, 3)] for _ in range(5)] + [[0.3, math.pi / 2, 0.2], [0.3, 0.0, 0.4], [1.0, -math.pi / 2, -0.5], [0.5, math.pi, 0.1], [0.0, 0.0, 0.0]]
    frame = spark.createDataFrame([(c, t) for c in vectors.CONVENTIONS for t in turns], "c string, t array<double>")
    q = vectors.angles_to_quaternion("t", F.col("c"))
    rows = frame.withColumn("m", vectors.quaternion_to_matrix(q)).withColumn("b", vectors.matrix_to_angles("m", F.col("c"))).collect()
    assert len(set(vectors.CONVENTIONS)) == 24 and len(rows) == 240

    def matrix(c, t):
        parts = [elementary("xyz".index(a), x) for a, x in zip(c[1:], t, strict=True)]
        return parts[2] @ parts[1] @ parts[0] if c[0] == "s" else parts[0] @ parts[1] @ parts[2]

    for r in rows:
        assert np.allclose(np.reshape(r["m"], (3, 3)), matrix(r["c"], r["t"])) and np.allclose(matrix(r["c"], r["b"]), matrix(r["c"], r["t"]), atol=1e-7)
    literal = frame.filter("c = 'rzyx'").select(vectors.quaternion_to_angles(vectors.angles_to_quaternion("t", "rzyx"), "rzyx").alias("b")).collect()
    assert np.allclose([r["b"] for r in literal[:5]], turns[:5])
    with pytest.raises(ValueError, match="unknown convention"):
        vectors.angles_to_quaternion("t", "sxxy")


def test_axis_and_angle(spark):
    rows = [([0.0, 0.0, 2.0], 1.0), ([1.0, 2.0, -2.0], 2.5), ([0.0, 0.0, 0.0], 1.0)]
    found = spark.createDataFrame(rows, "a array<double>, x double").select(vectors.axis_angle_to_quaternion("a", "x").alias("q"), vectors.quaternion_to_axis_angle(vectors.axis_angle_to_quaternion("a", "x")).alias("b")).collect()
    for (axis, angle), r in zip(rows, found, strict=True):
        size = math.sqrt(sum(v * v for v in axis))
        assert r["b"] == pytest.approx([*(v / size for v in axis), angle] if size else [1.0, 0.0, 0.0, 0.0])
        assert sum(v * v for v in r["q"]) == pytest.approx(1.0)


def test_equal_angles_are_turned_once(spark, tmp_path):
    from trajspark import catalog

    # 3 triples of angles on 60 parts; one size is null
    parts = [(k + 427 * n, size) for n in range(20) for k, size in ((1, 7), (2, None), (430, 9))]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.QUERIES["rotation_conventions"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate explode"):]  # below it in the plan
    again = {r["convention"]: (r["turns"], r["restored"]) for r in found.collect()}
    assert len(again) == 24 and set(again.values()) == {(60, 40)}
