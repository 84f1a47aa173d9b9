import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import diff, evaluation, packing, quality, selectors

SEGMENTS = "episode long, segment int, start long, end long, first long, last long, motion_score double"


def segments(spark, rows):
    return spark.createDataFrame(rows, SEGMENTS)


def sequential(ranked, target):
    covered, out = set(), []
    for s in ranked:
        if len(covered) >= target:
            break
        out.append((s[0], s[1]))
        covered.update((s[0], a) for a in range(s[4], s[5] + 1))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    rows = []
    for e in range(5):
        for k in range(8):
            a = rng.randrange(40)
            rows.append((e, k, a, a + 8, a, a + rng.randrange(8), float(rng.randrange(6))))
    df = segments(spark, rows)
    whole = {(r[0], a) for r in rows for a in range(r[4], r[5] + 1)}
    target = max(1, -(-len(whole) * 30 // 100))
    order = sorted(rows, key=lambda r: (-r[6], r[0], r[1]))
    got = {(r["episode"], r["segment"]) for r in selectors.select("motion_gripper", df, 0.3).collect()}
    assert got == set(sequential(order, target))


def test_whole_budget_and_unknown_selector(spark):
    df = segments(spark, [(0, 0, 0, 4, 0, 3, 1.0)])
    assert selectors.select("motion_gripper", df, 0.999).count() == 1
    with pytest.raises(ValueError):
        selectors.select("best", df, 0.5)


def test_random_selection_keeps_to_its_seed(spark):
    df = segments(spark, [(e, k, 4 * k, 4 * k + 4, 4 * k, 4 * k + 3, 0.0) for e in range(3) for k in range(6)])
    key = lambda x: sorted((r["episode"], r["segment"]) for r in x.collect())
    one = key(selectors.select("random", df, 0.5, seed=1))
    assert one == key(selectors.select("random", df.repartition(3), 0.5, seed=1)) and len(one) == 9


def test_motion_by_running_sums(spark):
    df = segments(spark, [(0, 0, 0, 3, 0, 2, 0.0), (0, 1, 2, 9, 2, 8, 0.0), (0, 2, 7, 9, 7, 8, 0.0)]).drop("motion_score")
    steps = spark.createDataFrame([(0, t, float(t)) for t in range(5)], "episode long, t long, motion double")
    assert [r["motion_score"] for r in selectors.with_motion(df, steps).orderBy("segment").collect()] == [3.0, 9.0, 0.0]


def test_nested_configs(spark):
    schema = "episode long, action_config array<struct<segment_id: int, start_frame: long, end_frame: long, action_loss_first: long, action_loss_last: long>>"
    df = spark.createDataFrame([(0, [(None, 0, 4, None, None), (9, 4, 8, 5, 6)]), (1, [])], schema)
    rows = {r["segment"]: r for r in selectors.segments_of(df).collect()}
    assert (rows[0]["first"], rows[0]["last"], rows[9]["first"], rows[9]["last"]) == (0, 3, 5, 6)
    manifest = spark.createDataFrame([(0, 4, 8)], "episode long, start long, end long")
    kept = selectors.filter_configs(df, manifest).collect()
    assert len(kept) == 1 and [c["segment_id"] for c in kept[0]["action_config"]] == [9]


def test_seed_aggregate_of_one_seed(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, x double")
    assert selectors.seed_aggregate(df, "x", ["k"]).first()["std"] == 0.0


def test_completeness(spark):
    tasks = spark.createDataFrame([("complete",), ("partial",), ("bad_rate",), ("missing",)], "task string")
    results = spark.createDataFrame([("complete", 2.0, 3.0, 2 / 3), ("partial", 1.0, 2.0, 0.5), ("bad_rate", 2.0, 3.0, 0.1)], "task string, succ_num double, total_num double, succ_rate double")
    found = {r["task"]: r["status"] for r in evaluation.completeness(tasks, results, "task", 3).collect()}
    assert found == {"complete": "complete", "partial": "partial", "bad_rate": "inconsistent", "missing": "missing"}
    assert evaluation.incomplete(tasks, results, "task", 3).count() == 3


def test_retry_rounds():
    done, left = evaluation.retry(["retry_me", "never_complete"], lambda task, n: task == "retry_me" and n == 1, 3)
    assert done == ["retry_me"] and left == ["never_complete"]


def test_equal_episode_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 10.0), (1, 20.0), (1, 30.0), (1, 40.0)], "e int, x double")
    assert evaluation.equal_episode_mean(df, "e", "x", 4).first()[0] == pytest.approx(6.75)


def items(spark, n=37):
    return spark.createDataFrame([(i, 128 * (4 + i % 20), "16,8,16,30,4,1") for i in range(n)], "index long, token_count long, shape_signature string")


@pytest.mark.parametrize("per_update", [80, 128, 256])
def test_packing_plan(spark, per_update):
    limits = packing.Limits(8, per_update // 8, 4096, 8)
    df = items(spark)
    occurring = packing.occurrences(df, packing.updates(spark, 5, 6), per_update, 37, 42)
    planned = packing.plan(occurring, df, limits).cache()
    assert sorted(r["sample_uid"] for r in planned.collect()) == list(range(5 * per_update, 6 * per_update))
    assert packing.plan_violations(planned, df, limits).count() == 0
    assert packing.oversized(df, 4096).count() == 0


def test_every_epoch_is_a_permutation(spark):
    df = items(spark, 10)
    rows = packing.occurrences(df, packing.updates(spark, 0, 5), 16, 10, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["epoch"], []).append(r["index"])
    assert all(sorted(v) == list(range(10)) for v in by.values()) and len(by) == 8


def test_cursor():
    cursor = packing.Cursor({"seed": 1})
    cursor.commit(0)
    with pytest.raises(ValueError):
        cursor.commit(0)
    again = packing.Cursor({"seed": 1})
    again.load(cursor.state())
    assert again.next_update == 1
    with pytest.raises(ValueError):
        packing.Cursor({"seed": 2}).load(cursor.state())


def test_collate_offsets(spark):
    df = spark.createDataFrame([(0, 0, [1.0] * 3), (0, 1, [2.0] * 5)], "g int, k int, v array<double>")
    row = packing.collate(df, ["g"], "k", "v").first()
    assert row["offsets"] == [0, 3, 8] and row["lengths"] == [3, 5] and row["values"] == [1.0] * 3 + [2.0] * 5


def test_resume(spark):
    df = spark.range(12).withColumnRenamed("id", "place")
    assert packing.suffix(df.selectExpr("*", "3 as epoch"), 4, 3).count() == 8 and packing.suffix(df.selectExpr("*", "4 as epoch"), 4, 3).count() == 12


def test_diff_statuses(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    right = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, x string")
    assert {r["k"]: r["status"] for r in diff.compare(left, right, ["k"], ["x"]).collect()} == {1: "missing", 2: "changed", 4: "extra"}
    assert diff.same_rows(left, left) and not diff.same_rows(left, right) and diff.same_set(left, left, ["k"])


def test_optimizer_states(spark):
    schema = "parameter_name string, optimizer_group_index int, position_in_group int, parameter_shape array<int>, parameter_dtype string, optimizer_state_present boolean, has_received_gradient boolean"
    base = [("a.weight", 0, 0, [2], "f32", True, True), ("b.bias", 0, 1, [2], "f32", True, True), ("never.weight", 0, 2, [2], "f32", False, False)]
    saved = spark.createDataFrame(base, schema)
    assert quality.optimizer_state_rules(saved, saved).count() == 0
    moved = spark.createDataFrame([("a.weight", 0, 1, [2], "f32", True, True), ("b.bias", 0, 0, [2], "f32", True, True), base[2]], schema)
    assert {r["rule"] for r in quality.optimizer_state_rules(saved, moved).collect()} == {"order"}
    lost = spark.createDataFrame([("a.weight", 0, 0, [2], "f32", False, True), *base[1:]], schema)
    assert {r["rule"] for r in quality.optimizer_state_rules(lost, saved).collect()} == {"empty_state"}


def test_id_selection(spark):
    known = spark.createDataFrame([(1,), (2,)], "e long")
    assert {r["rule"] for r in quality.id_selection(known, [1, 1, 7], "e").collect()} == {"repeated", "unknown"}
    assert quality.verdict(quality.id_selection(known, [1], "e")).first()["passed"]


def test_marker_pins_artifacts(spark):
    digest = "a" * 64
    marker = spark.createDataFrame([("x.json", digest)], "name string, sha256 string")
    assert quality.marker_rules(marker, marker).count() == 0
    stale = spark.createDataFrame([("x.json", "b" * 64)], "name string, sha256 string")
    assert [r["rule"] for r in quality.marker_rules(marker, stale).collect()] == ["digest"]


def test_coverage_of_everything(spark):
    df = segments(spark, [(0, 0, 0, 25, 0, 24, 0.0)])
    episodes = spark.createDataFrame([(0, 25)], "episode long, length long")
    rows = selectors.coverage(df, episodes, 10).collect()
    assert all(r["coverage_ratio"] == 1.0 for r in rows) and sum(r["total"] for r in rows) == 25
    assert df.agg(F.count(F.lit(1))).first()[0] == 1


def test_packing_queries_hold_every_document(spark):
    from trajspark.plans import rule_queries, selection_queries

    at = "/root/testdata/sf0.01"
    rows = selection_queries.lpt_bfd_packing(spark, at).collect()
    sizes = {r["doc_id"]: -(-r["n_chars"] // 128) * 128 for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "n_chars").collect()}
    over = {r["index"] for r in rows if r["update_id"] is None}
    assert over == {i for i, n in sizes.items() if n > 16384} and over
    assert {r["index"] for r in rows if r["update_id"] is not None} == set(sizes) - over
    assert rule_queries.packing_violations(spark, at).first()["violations"] == 0
