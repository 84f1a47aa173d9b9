"""Array files behind commits, views of data sets, latent records, shard summaries."""

import glob
import io
import json
import os

import numpy as np
import pytest

from trajspark.operators import contracts
from trajspark.sources import artifacts, readers, sinks

PREFIX, WIDTH = contracts.ZERO_PREFIX, contracts.ACTION_WIDTH


def rows(names, real=16, fill=0.5, width=WIDTH):
    action = [[0.0] * width] * PREFIX + [[fill] * (width - 1) + [0.0]] * real
    return [(n, action, [0.25] * contracts.ANCHOR_WIDTH, real + 3, f"{n}-digest") for n in names]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, artifacts.WRITTEN).repartition(parts)


def test_files_are_arrays_that_numpy_reads(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_sidecars(frame(spark, rows("abcde")), path)
    files = glob.glob(f"{path}/files/*/*.npz")
    assert len(files) == 5
    one = np.load(files[0])
    assert one["action_19d"].shape == (PREFIX + 16, WIDTH) and one["action_19d"].dtype == np.float32 and one["loss_mask_19d"].all()
    assert one["source_frame_ids"].tolist() == [-1] * PREFIX + list(range(16)) and int(one["tail_discarded_count"]) == 3
    found = {r["name"]: r for r in artifacts.read_sidecars(spark, path).collect()}
    assert set(found) == set("abcde") and all(r["error"] is None and r["source_sha256"] == f"{n}-digest" for n, r in found.items())
    assert found["a"]["action"][PREFIX][0] == 0.5 and found["a"]["real_action_count"] == 16


def test_files_without_a_commit_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_sidecars(frame(spark, rows("ab")), path)
    lost = f"{path}/files/lost"
    os.makedirs(lost)
    with open(f"{lost}/000000.npz", "wb") as f:
        f.write(artifacts.encode(np.zeros((PREFIX, WIDTH)), np.zeros(12), 1, "x"))
    with open(f"{path}/manifest/lost.jsonl", "w") as f:
        f.write(json.dumps({"name": "z", "path": "files/lost/000000.npz", "bytes": 1, "sha256": "x"}) + "\n")
    assert sorted(r["name"] for r in artifacts.read_sidecars(spark, path).select("name").collect()) == ["a", "b"]
    artifacts.write_sidecars(frame(spark, rows("c")), path, mode="append")
    assert sorted(r["name"] for r in artifacts.read_sidecars(spark, path).select("name").collect()) == ["a", "b", "c"]
    assert not os.path.exists(lost)
    artifacts.write_sidecars(frame(spark, rows("d")), path)
    assert [r["name"] for r in artifacts.read_sidecars(spark, path).select("name").collect()] == ["d"]
    assert len(glob.glob(f"{path}/files/*/*.npz")) == 1


@pytest.mark.parametrize("bad", [("r", [[0.0] * WIDTH] * PREFIX + [[0.0] * 3], [0.0] * 12, 1, "x"), (None, [[0.0] * WIDTH] * PREFIX, [0.0] * 12, 1, "x"), ("s", [[0.0] * WIDTH] * 3, [0.0] * 12, 1, "x")])
def test_a_failed_write_leaves_the_last_commit(spark, tmp_path, bad):
    path = str(tmp_path / "s")
    artifacts.write_sidecars(frame(spark, rows("ab")), path)
    with pytest.raises(Exception, match="sidecar"):
        artifacts.write_sidecars(frame(spark, [*rows("cd"), bad]), path)
    assert sorted(r["name"] for r in artifacts.read_sidecars(spark, path).select("name").collect()) == ["a", "b"]


def test_no_commit_and_an_empty_one(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        artifacts.read_sidecars(spark, str(tmp_path / "none"))
    artifacts.write_sidecars(frame(spark, rows("")), str(tmp_path / "s"))
    assert artifacts.read_sidecars(spark, str(tmp_path / "s")).count() == 0


def test_faults_of_files_and_their_sources(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_sidecars(frame(spark, rows("abcdef"), 1), path)
    artifacts.write_sidecars(frame(spark, rows("f"), 1), path, mode="append")
    listed = {}
    for m in glob.glob(f"{path}/manifest/*.jsonl"):
        for line in open(m):
            r = json.loads(line)
            listed.setdefault(r["name"], (m, r))
    os.remove(f"{path}/{listed['a'][1]['path']}")
    with open(f"{path}/{listed['b'][1]['path']}", "wb") as f:
        f.write(b"other")
    manifest, c = listed["c"]
    with open(f"{path}/{c['path']}", "wb") as f:  # an archive without the arrays, listed with its own digest
        out = io.BytesIO()
        np.savez(out, other=np.zeros(1))
        f.write(out.getvalue())
    lines = [json.loads(x) for x in open(manifest)]
    import hashlib

    for r in lines:
        if r["name"] == "c":
            r["sha256"] = hashlib.sha256(out.getvalue()).hexdigest()
    with open(manifest, "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in lines)
    for crc in glob.glob(f"{path}/manifest/.*.crc"):
        os.remove(crc)
    sources = spark.createDataFrame([(n, 19, f"{n}-digest" if n != "d" else "new") for n in "abcdefg"], "name string, raw_length long, raw_sha256 string")
    found = sorted(tuple(r) for r in artifacts.sidecar_faults(artifacts.read_sidecars(spark, path), sources).collect())
    assert found == [("a", "missing"), ("b", "changed"), ("c", "unreadable"), ("d", "source_digest"), ("f", "repeated_sidecar"), ("g", "no_sidecar")]


def test_views_hold_metadata_only(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "view")
    data = spark.createDataFrame([(e, e // 2, float(e * 10 + t)) for e in range(6) for t in range(3)], "episode long, chunk long, x double")
    sinks.parquet(data, source, by=["chunk"])
    kind = "episode long, chunk long, task string, action_config array<struct<start_frame: long, end_frame: long>>"
    episodes = spark.createDataFrame([(e, e // 2, f"t{e}", [(0, 2), (2, 3)]) for e in range(6)], kind)
    manifest = spark.createDataFrame([(1, 0, 2), (1, 0, 2), (4, 2, 3), (5, 0, 3)], "episode long, start long, end long")
    summary = artifacts.write_view(episodes, manifest, {"fps": 30, "total_episodes": 6}, source, path)
    assert summary == {"selected_episodes": 2, "manifest_segments": 4, "kept_segments": 2, "dropped_manifest_segments": 2}
    assert sinks.read_json(f"{path}/meta/info.json") == {"fps": 30, "total_episodes": 2}
    kept = {r["episode"]: (r["task"], [tuple(c) for c in r["action_config"]]) for r in artifacts.view_episodes(spark, path).collect()}
    assert kept == {1: ("t1", [(0, 2)]), 4: ("t4", [(2, 3)])}
    found = artifacts.view_rows(spark, path, ["chunk", "episode"], ["x"])
    assert sorted(r["x"] for r in found.collect()) == [10.0, 11.0, 12.0, 40.0, 41.0, 42.0]
    assert not glob.glob(f"{path}/**/*.parquet", recursive=True)
    with pytest.raises(ValueError, match="no config"):
        artifacts.write_view(episodes, manifest.filter("episode = 5"), {}, source, path)
    with pytest.raises(FileNotFoundError):
        artifacts.view_episodes(spark, path)


def test_summaries_of_ranks_count_only_without_those_of_attempts(spark, tmp_path):
    both, old = str(tmp_path / "both"), str(tmp_path / "old")
    for folder in (both, old):
        sinks.atomic_json(f"{folder}/lineage_rank0_summary.json", {"rank": 0, "shards": [{"path": "old-0", "sha256": "x"}]})
        sinks.atomic_json(f"{folder}/lineage_rank1_summary.json", {"rank": 1, "shards": [{"path": "old-1", "sha256": "x"}, {"path": "old-0", "sha256": "x"}]})
        sinks.atomic_json(f"{folder}/other.json", {"rank": 1, "shards": [{"path": "none", "sha256": "x"}]})
    sinks.atomic_json(f"{both}/lineage_rank0_a2_summary.json", {"rank": 0, "shards": [{"path": "new", "sha256": "x"}]})
    assert [r["path"] for r in readers.shard_files(spark, both).collect()] == ["new"]
    assert sorted(r["path"] for r in readers.shard_files(spark, old).collect()) == ["old-0", "old-1"]
    os.makedirs(tmp_path / "empty")
    assert readers.shard_files(spark, str(tmp_path / "empty")).count() == 0


def test_latent_records_without_a_field_differ(spark):
    kind = ("k long, file string, want_length int, want_task string, want_camera string, want_frame_ids array<int>, want_fps int, latent_shape array<int>, latent_dtype string, latent_num_frames int, "
            "latent_height int, latent_width int, video_num_frames int, source_video_num_frames int, video_height int, video_width int, text string, camera_key string, frame_ids array<int>, start_frame int, "
            "end_frame int, fps int, ori_fps int, image_stride int, finite boolean, has_text_embedding boolean")
    good = ["f", 36, "t", "left", list(range(0, 36, 4)), 30, [3 * 196, 48], "bfloat16", 3, 14, 14, 9, 36, 224, 224, "t", "left", list(range(0, 36, 4)), 0, 36, 30, 30, 4, True, False]
    lacking = [(i, *good[:i], None, *good[i + 1:]) for i in range(6, len(good))]
    found = contracts.latent_rules(spark.createDataFrame([(0, *good), *lacking, (99, None, *good[1:])], kind), "k").collect()
    assert sorted(r["rule"] for r in found) == sorted([f"differing_{c.split()[0]}" for c in kind.split(", ")[7:]] + ["missing_file"])


def test_payloads_are_those_of_json(spark):
    from pyspark.sql import functions as F

    from trajspark.functions import scalars

    values = [0.1, 1e16, 1e-5, 123456789.123, 2e-3, 1e23, -0.0, 5e-324, 1e15, 3.0, None]
    kind = "word string, x double, n long, l array<double>, m map<string, struct<b: boolean, a: string>>, d date"
    rows = [(f"é\u4e2d\U0001f600 {i} \\n\"", v, i if i % 2 else None, [v, None], {"z": (True, "q"), "a": (None, None)}, None) for i, v in enumerate(values)]
    found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + kind).select("i", F.struct(*[k.split(" ")[0] for k in ("word", "x", "n", "l", "m", "d")]).alias("p"))
    got = {r["i"]: r["j"] for r in found.select("i", scalars.payload_json("p").alias("j")).collect()}
    for i, (word, x, n, items, m, d) in enumerate(rows):
        own = {"word": word, "x": x, "n": n, "l": items, "m": {k: {"b": b, "a": a} for k, (b, a) in m.items()}, "d": d}
        assert got[i] == json.dumps(own, sort_keys=True, separators=(",", ":"))


def test_segments_without_fields(spark):
    from trajspark.operators import selectors

    kind = "episode long, length long, action_config array<struct<start_frame: int, end_frame: int>>"
    rows = spark.createDataFrame([(1, 10, [(0, 12), None, (5, 5)]), (2, 4, []), (3, 9, None)], kind)
    found = [tuple(r) for r in selectors.segment_fields(rows).orderBy("segment").collect()]
    assert found == [(1, 0, 0, 12, 0, 9, [0, 4, 8], 10, False, False), (1, 2, 5, 5, 5, 4, [], 0, False, False)]


def test_equal_inventories_and_streams_have_no_difference(spark):
    from trajspark.operators import diff

    state = spark.createDataFrame([("a", *["x"] * len(diff.STATE_FIELDS)), ("b", *[None] * len(diff.STATE_FIELDS))], ", ".join(f"{c} string" for c in ("parameter_name", *diff.STATE_FIELDS)))
    assert tuple(diff.inventory_report(state, state).first()) == (0, 0, 0, True, "")
    rows = spark.createDataFrame([(s, r, s, 0, "i", f"a{s}") for s in range(5) for r in range(2)], "optimizer_step long, rank long, microbatch_id long, gradient_accumulation_index long, items string, attempt string")
    assert diff.compare_signatures(rows, rows.withColumn("attempt", diff.F.lit("other")), ["items"]).count() == 0


def test_no_array_of_a_sidecar_meets_its_source(spark, tmp_path):
    path = str(tmp_path / "sidecars")
    artifacts.write_sidecars(frame(spark, rows("ab"), 1), path)
    sources = spark.createDataFrame([("a", 19, "a-digest"), ("b", 20, "b-digest")], "name string, raw_length long, raw_sha256 string")
    faults = artifacts.sidecar_faults(artifacts.read_sidecars(spark, path), sources)
    plan = faults._jdf.queryExecution().optimizedPlan().toString()
    # a join that sees arrays may send them all through the driver, and each of its branches decodes every file again
    assert "Join" in plan and "MapInArrow" not in plan and "action#" not in plan and "mask#" not in plan
    assert {r["rule"] for r in faults.filter("key = 'b'").collect()} >= {"source_length"} and faults.filter("key = 'a'").count() == 0
