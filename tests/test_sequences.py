import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.functions import scalars, vectors
from trajspark.operators import lineage, sequences


@pytest.mark.parametrize("length,rows", [(1, 0), (16, 0), (17, 16), (32, 16), (33, 32), (49, 48), (3300, 3296)])
def test_aligned_rows(spark, length, rows):
    assert spark.range(1).select(sequences.aligned_rows(F.lit(length))).first()[0] == rows


@pytest.mark.parametrize("frames,expected", [(193, [(0, 192)]), (194, [(0, 192), (192, 193)]), (270, [(0, 192), (192, 269)]), (1, [])])
def test_segment_plan(spark, frames, expected):
    df = spark.createDataFrame([(0, frames)], "episode int, frames long")
    found = sequences.plan_segments(df, "frames", 81920, ["episode"]).orderBy("ordinal").collect()
    assert [(r["start"], r["stop"]) for r in found] == expected


def test_prefix_and_tail_are_left_out_of_quantiles(spark):
    rows = [(0, t, 10.0 if t < 32 else 999.0) for t in range(33)]
    df = spark.createDataFrame(rows, "e int, t long, x double")
    padded = sequences.pad_and_trim(df, ["e"], "t", "x")
    assert padded.count() == 48 and padded.filter("t < 0").agg(F.max("x")).first()[0] == 0.0
    real = padded.filter("t >= 0").select(F.array("x").alias("a"))
    row = sequences.channel_quantiles(real, "a").first()
    assert (row["q01"], row["q99"], row["non_finite"]) == (10.0, 10.0, 0)


def test_non_finite_values_are_counted(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([2.0, 3.0],)], "a array<double>")
    found = {r["channel"]: r["non_finite"] for r in sequences.channel_quantiles(df, "a").collect()}
    assert found == {0: 0, 1: 1}


def test_reanchor(spark):
    rows = [(0, t, float(t), float(3 * t + 3), t // 16) for t in range(48)]
    df = spark.createDataFrame(rows, "e int, t long, x double, cum double, s long")
    found = {r["t"]: r for r in sequences.reanchored(df, "x", "cum", ["e"], "s", ["t"]).collect()}
    assert found[16]["x_local"] == 0 and found[31]["x_local"] == 15
    assert found[0]["cum_local"] == 3 and found[16]["cum_local"] == 3 and found[17]["cum_local"] == 6


def test_motion_counts_gripper_twice(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [3.0, 4.0])], "e int, t int, a array<double>")
    found = [r["motion"] for r in sequences.motion_score(df, "a", ["e"], ["t"], (1,)).orderBy("t").collect()]
    assert found == [0.0, 5.0 + 8.0]


def test_target_times(spark):
    row = spark.createDataFrame([(9, 30)], "n int, real int").select(lineage.target_times(F.col("n"), real=F.col("real")).alias("t")).first()["t"]
    assert row[:16] == [-1] * 16 and row[16:46] == list(range(30)) and set(row[46:]) == {-1} and len(row) == 48


def test_contiguity_of_a_whole_plan(spark):
    df = spark.createDataFrame([(0, 500)], "episode int, frames long")
    plan = sequences.plan_segments(df, "frames", 81920, ["episode"])
    assert sequences.contiguity_violations(plan, ["episode"], "frames").count() == 0
    rules = {r["rule"] for r in sequences.contiguity_violations(plan.filter("ordinal <> 0"), ["episode"], "frames").collect()}
    assert rules == {"ordinal", "start"}


def test_channel_roundtrip(spark):
    places = [14, 15, 16, 17, 18, 19, 28, 20, 21, 22, 23, 24, 25, 26, 29, 27, 0, 1, 2]
    values = [float(i + 1) for i in range(19)]
    df = spark.createDataFrame([(values,)], "a array<double>")
    wide = df.withColumn("w", scalars.scatter("a", dict(enumerate(places)), 30))
    row = wide.select("w", scalars.gather("w", places).alias("b"), scalars.gather("a", [19]).alias("pad")).first()
    assert row["b"] == values and sum(row["w"]) == sum(values) and row["pad"] == [0.0]


def test_normalise_clips_and_fixes(spark):
    df = spark.createDataFrame([(5.0, 0.0, 1.0), (0.5, 0.0, 1.0)], "x double, lo double, hi double")
    found = [r[0] for r in df.select(scalars.quantile_normalise("x", "lo", "hi")).collect()]
    assert found[0] == 1.5 and abs(found[1]) < 1e-5
    assert df.select(scalars.quantile_normalise("x", "lo", "hi", F.lit(True))).first()[0] == 0.0


def test_cosine_of_a_zero_vector_is_nan(spark):
    row = spark.range(1).select(vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()
    assert math.isnan(row[0])


def test_rotations_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    angles = [tuple(map(float, x)) for x in rng.uniform(-1.4, 1.4, (20, 3))]
    df = spark.createDataFrame(angles, "r double, p double, y double").withColumn("q", vectors.euler_to_quaternion("r", "p", "y"))
    df = df.select("*", vectors.quaternion_to_euler("q").alias("e"), vectors.quaternion_to_matrix("q").alias("m"), vectors.quaternion_to_axis_angle("q").alias("a"),
                   vectors.quaternion_product("q", vectors.quaternion_inverse("q")).alias("one"))
    for row in df.collect():
        r, p, y = row["r"], row["p"], row["y"]
        rx = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
        ry = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
        rz = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
        assert np.allclose(np.array(row["m"]).reshape(3, 3), rz @ ry @ rx)
        assert np.allclose(row["e"], [r, p, y]) and np.allclose(row["one"], [1, 0, 0, 0])
        assert np.isclose(np.trace(rz @ ry @ rx), 1 + 2 * math.cos(row["a"][3]))


def test_relative_pose(spark):
    q = [math.cos(0.3), 0.0, 0.0, math.sin(0.3)]
    df = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0], q), (0, 1, [2.0, 2.0, 3.0], q)], "e int, t int, x array<double>, q array<double>")
    last = sequences.relative_pose(df, "x", "q", ["e"], ["t"]).orderBy("t").collect()[1]
    assert last["x_rel"] == [1.0, 0.0, 0.0] and np.allclose(last["q_rel"], [1, 0, 0, 0])


def test_stateless_seed_is_the_plain_definition(spark):
    import hashlib

    got = spark.range(3).select(scalars.stateless_seed(42, "id", "w")).collect()
    want = [int.from_bytes(hashlib.blake2b(f"42:{i}:w".encode(), digest_size=8).digest(), "little") % (2**63 - 1) for i in range(3)]
    assert [r[0] for r in got] == want


def test_scalar_rules(spark):
    row = spark.range(1).select(
        scalars.parameter_name(F.lit("module._fsdp_wrapped_module.module.a._fsdp_wrapped_module.b")).alias("name"),
        scalars.selector_of(F.lit("x_b1_b025")).alias("s"), scalars.budget_of(F.lit("x_b1_b025")).alias("b"),
        scalars.round_up(F.lit(129), 128).alias("u"), scalars.half_even(F.lit(2.5)).alias("h"), scalars.ramp(F.lit(5), 10).alias("w"),
        scalars.is_integer_count(F.lit("3.0")).alias("i"), scalars.is_integer_count(F.lit("3.5")).alias("j"), scalars.is_safe_relative_path(F.lit("a/../b")).alias("p"),
        scalars.timestep_id(F.lit(1.0), 1000).alias("t"), scalars.name_guess(F.lit("My_RoboCup"), {"robo": "r"}, "?").alias("g"),
        F.sort_array(F.map_keys(scalars.flatten_map(F.expr("map('a', map('x', 1, 'y', 2))")))).alias("f"), scalars.array_profile(F.array(F.lit(1.0), F.lit(3.0))).alias("a"),
        scalars.shift_for_length(F.lit(1000.0), (500.0, 1.0), (1500.0, 3.0)).alias("mu"),
    ).first()
    assert row["name"] == "a.b" and row["s"] == "x_b1" and row["b"] == 0.25 and row["u"] == 256 and row["h"] == 2 and row["w"] == 0.5
    assert row["i"] and not row["j"] and not row["p"] and row["t"] == 999 and row["g"] == "r" and row["f"] == ["a.x", "a.y"]
    assert row["a"]["mean"] == 2.0 and row["mu"] == 2.0
