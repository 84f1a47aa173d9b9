import json
import struct

import pytest
from pyspark.sql import functions as F

from trajspark.sources import readers, sinks
from trajspark.streaming import streams


def test_json_lines(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\nnot json\n[1]\n')
    assert [r["a"] for r in readers.jsonl(spark, str(path), "a int").filter("a is not null").collect()] == [1, 2]
    assert [(r["line"], r["value"]) for r in readers.jsonl_errors(spark, str(path)).collect()] == [(4, "not json"), (5, "[1]")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        readers.jsonl_strict(spark, str(path), "a int").collect()


def test_episode_ids_come_from_paths(spark, tmp_path):
    for e in (3, 12):
        spark.createDataFrame([([float(e)], 1)], "`action.joints` array<float>, other int").write.parquet(str(tmp_path / f"chunk-000/episode_{e:06d}.parquet"))
    df = readers.episodes(spark, str(tmp_path), ["action.joints"])
    assert sorted(r["episode_index"] for r in df.collect()) == [3, 12] and df.columns == ["episode_index", "action.joints"]


def test_repositories_and_inventory(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name / "meta").mkdir(parents=True)
        (tmp_path / name / "meta/info.json").write_text("{}")
    found = readers.repositories(spark, [str(tmp_path), str(tmp_path)]).collect()
    assert [r["dataset"] for r in found] == ["a", "b"]
    files = readers.inventory(spark, str(tmp_path), "info.json")
    assert files.count() == 2 and readers.tree_digest(files).first()[0]


def test_shards_are_those_listed(spark, tmp_path):
    (tmp_path / "rank0.json").write_text(json.dumps({"rank": 0, "shards": [{"path": "x/p1", "sha256": "s"}]}))
    assert readers.shard_paths(spark, str(tmp_path / "rank*.json")) == ["x/p1"]


def test_logs(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("2026-01-01 00:00:00 start\nTraining: step=1, eff_labels=5\rTraining: step=1, eff_labels=7\r\n2026-01-01 01:30:00 Training: step=2, eff_labels=1e1\n")
    lines = readers.log_lines(spark, str(path))
    assert {r["step"]: r["eff_labels"] for r in readers.last_by_step(lines, ["eff_labels"]).collect()} == {1: 7.0, 2: 10.0}
    assert readers.log_span_hours(lines).first()[0] == 1.5


def test_key_values_and_ranges(spark, tmp_path):
    path = tmp_path / "r.txt"
    path.write_text("Success Rate: 0.5\nReward: 2\nSuccess Rate: 0.75\n")
    row = readers.key_values(readers.log_lines(spark, str(path)), ["Success Rate", "Reward"]).first()
    assert (row["success_rate"], row["reward"]) == (0.75, 2.0)
    got = spark.range(1).select(readers.region_ranges(F.lit("(:ranges ((0.1 -0.2 0.3 0.4) (1 2 3 4)))"))).first()[0]
    assert got == [[0.1, -0.2, 0.3, 0.4], [1.0, 2.0, 3.0, 4.0]]


def test_results_and_rollouts(spark, tmp_path):
    (tmp_path / "s1/t1").mkdir(parents=True)
    (tmp_path / "s1/t1/res.json").write_text('{"succ_num": 1, "total_num": 2, "succ_rate": 0.5}')
    row = readers.results(spark, str(tmp_path / "*/*/res.json"), r"/([^/]+)/([^/]+)/res\.json$").first()
    assert (row["suite"], row["task"], row["succ_rate"]) == ("s1", "t1", 0.5)
    for name in ("1_True.mp4", "2_False.mp4", "3_True.mp4", "x.mp4"):
        (tmp_path / "s1/t1" / name).write_bytes(b"x")
    row = readers.rollouts(spark, str(tmp_path)).first()
    assert (row["task"], row["succ_num"], row["total_num"]) == ("t1", 2, 3)


def test_tensor_headers(spark, tmp_path):
    header = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + bytes(24))
    tensors = readers.tensor_schema(spark, str(tmp_path))
    row = tensors.first()
    assert (row["name"], row["dtype"], row["shape"]) == ("w", "F32", [2, 3]) and readers.schema_digest(tensors).count() == 1


def test_csv_and_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert readers.csv_rows(spark, str(tmp_path / "a.csv")).first()["source_csv"] == "a.csv"
    assert readers.profile(spark, str(tmp_path / "none.parquet"))["error"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m|x", 1.0 / 3, 7)], "metric string, value double, optimizer_step int")
    text = sinks.markdown(df.drop("optimizer_step"), "Card")
    assert "| m/x | 0.3333333333 |" in text
    sinks.atomic_json(str(tmp_path / "x.json"), {"b": 1, "a": 2})
    assert json.loads((tmp_path / "x.json").read_text()) == {"a": 2, "b": 1}
    assert sinks.digests(str(tmp_path)).endswith("  x.json\n")
    sinks.bundle(str(tmp_path), str(tmp_path.parent / "b.zip"))
    sinks.lineage_shards(df, str(tmp_path / "shards"), 5)
    assert spark.read.parquet(str(tmp_path / "shards")).first()["shard"] == 1
    sinks.published(df, str(tmp_path / "pub"), {"rows": 1})
    assert (tmp_path / "pub/_PUBLISHED.json").exists() and spark.read.parquet(str(tmp_path / "pub")).count() == 1
    sinks.csv(df, str(tmp_path / "c"))
    sinks.jsonl(df, str(tmp_path / "j"))
    sinks.view(df, "some_view")
    assert spark.table("some_view").count() == readers.csv_rows(spark, str(tmp_path / "c")).count() == 1


def test_session_machine(spark, tmp_path):
    rows = [("a", 1, "cache", 4), ("a", 2, "predict", 2), ("a", 3, "cache", 4), ("a", 4, "reset", 0), ("a", 5, "infer", 0)]
    spark.createDataFrame(rows, "session string, seq long, op string, frames long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.files(spark, str(tmp_path / "in"), "session string, seq long, op string, frames long")
    out = streams.run_once(streams.sessions(stream), "sessions_test", str(tmp_path / "ck"))
    found = [(r["seq"], r["cursor"], r["predicted"], r["resets"]) for r in out.orderBy("seq").collect()]
    assert found == [(1, 4, 0, 0), (2, 4, 2, 0), (3, 8, 0, 0), (4, 0, 0, 1), (5, 0, 0, 1)]


def test_ensemble_with_reset(spark, tmp_path):
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0])]
    spark.createDataFrame(rows, "k string, n long, v array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.files(spark, str(tmp_path / "in"), "k string, n long, v array<double>")
    out = streams.run_once(streams.ensemble(stream, "k", "n", "v", 2, 0.0), "ensemble_test", str(tmp_path / "ck")).orderBy("n").collect()
    assert out[0]["ensemble"] == [1.0, 0.0] and out[1]["ensemble"] == [0.5, 0.5]


def test_dropped_records(spark):
    r = spark.createDataFrame([(0, 1), (0, 1), (0, 2)], "training_attempt_id int, optimizer_step int")
    k = spark.createDataFrame([(0, 2)], "training_attempt_id int, optimizer_step int")
    assert [tuple(x) for x in streams.uncommitted(r, k).collect()] == [(0, 1, 2)]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    texts = {"a": "".join(f"line {i}" + ("\r" if i % 7 == 3 else "\r\n" if i % 5 == 1 else "\n") for i in range(500)), "b": "\n\nonly\n\n", "c": "", "d": "last without end"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        found = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5  # one file is read by several tasks
        rows = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r for r in rows if r[0] == "a"] == [("a", i + 1, f"line {i}") for i in range(500)]
    assert [r for r in rows if r[0] != "a"] == [("b", 1, ""), ("b", 2, ""), ("b", 3, "only"), ("b", 4, ""), ("d", 1, "last without end")]
