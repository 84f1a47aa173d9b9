"""Stock tables written by the sinks to the shared folder, and read again by the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars
from ..operators import datasets, lineage, quality, selectors
from ..sources import readers, sinks
from ..streaming import streams
from . import roles
from .registry import query


def _lines(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """Rows of one text column as lines of text files."""
    path = scratch.place(spark, name)
    rows.write.text(path)
    return path


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.place(spark, "jsonl")
    sinks.jsonl(roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return readers.jsonl_strict(spark, path, "o_orderkey LONG, o_orderstatus STRING, o_totalprice DOUBLE")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS k, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1")
def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines are skipped, malformed ones give nulls."""
    k = F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"k": '), k)).otherwise(F.concat(F.lit('{"k": '), k, F.lit("}")))
    path = _lines(spark, roles.table(spark, sf_dir, "orders").select(line.alias("value")), "lines")
    return readers.jsonl(spark, path, "k LONG").groupBy(F.coalesce("k", F.lit(-1)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '[' || o_orderkey || ']' AS value FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT '{\"k\": ' || o_orderkey FROM orders WHERE o_orderkey % 50 = 1")
def jsonl_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold no JSON object."""
    k = F.col("o_orderkey").cast("string")
    line = (F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("["), k, F.lit("]"))).when(F.col("o_orderkey") % 50 == 1, F.concat(F.lit('{"k": '), k))
            .when(F.col("o_orderkey") % 50 == 2, " ").otherwise(F.concat(F.lit('{"k": '), k, F.lit("}"))))
    path = _lines(spark, roles.table(spark, sf_dir, "orders").select(line.alias("value")), "lines")
    return readers.jsonl_errors(spark, path).select("value")


@query("SELECT 25::BIGINT AS n")
def scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that reaches the scan: how many rows it gives (the limit is the operator)."""
    return readers.first_lines(roles.table(spark, sf_dir, "orders").select("o_orderkey"), 25).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, max(o_totalprice) AS most FROM orders")
def json_object_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = roles.table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most")).first()  # one row
    path = f"{scratch.place(spark, 'object')}/card.json"
    sinks.atomic_json(path, row.asDict())
    return readers.json_object(spark, path, "n LONG, most DOUBLE")


@query("SELECT c_nationkey::BIGINT AS episode_index, c_custkey, c_acctbal FROM customer")
def episode_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode files by folder, read with the id of their path and two columns of theirs."""
    path = scratch.place(spark, "episodes")
    rows = roles.table(spark, sf_dir, "customer")
    sinks.parquet(rows.withColumn("part", F.format_string("episode_%06d", F.col("c_nationkey").cast("long"))), path, by=["part"])
    return readers.episodes(spark, path, ["c_custkey", "c_acctbal"])


@query("SELECT n_name AS dataset FROM nation WHERE n_nationkey % 3 <> 0")
def repository_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets under two roots, one of which lies in the other, each found once by its info.json."""
    root = scratch.place(spark, "repositories")
    for r in roles.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        at = f"{root}/group-{r['n_nationkey'] % 2}/{r['n_name']}/meta"
        sinks.atomic_json(f"{at}/info.json" if r["n_nationkey"] % 3 else f"{at}/other.json", {"name": r["n_name"]})
    return readers.repositories(spark, [root, f"{root}/group-1"]).select("dataset")


@query("SELECT 'dir/' || n_nationkey || '.bin' AS path, octet_length(encode(n_name)) + 3 AS size, sha256(n_name || '" + "{}\n" + "') AS sha256 FROM nation")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, sizes and digests of files."""
    root = scratch.place(spark, "inventory")
    for r in roles.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        sinks.atomic_bytes(f"{root}/dir/{r['n_nationkey']}.bin", (r["n_name"] + "{}\n").encode())
    found = readers.inventory(spark, root, "*.bin")
    return found.select(F.regexp_extract("path", r"(dir/[^/]+)$", 1).alias("path"), "size", "sha256")


@query("SELECT r::INT AS rank, i AS file FROM range(0, 3) x(r), range(0, 4) y(i) WHERE i <= r")
def shard_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the ranks' summaries list, read by name; a file that none lists doesn't count."""
    root = scratch.place(spark, "summaries")
    rows = roles.table(spark, sf_dir, "region").limit(1)
    for rank in range(3):
        for i in range(4):
            sinks.parquet(rows.select(F.lit(rank).alias("rank"), F.lit(i).cast("long").alias("file")), f"{root}/data/r{rank}-{i}")
        sinks.atomic_json(f"{root}/summary/r{rank}.json", {"rank": rank, "shards": [{"path": f"{root}/data/r{rank}-{i}", "sha256": ""} for i in range(rank + 1)]})
    return spark.read.parquet(*readers.shard_paths(spark, f"{root}/summary"))


@query("SELECT s_suppkey, s_name, s_acctbal, true AS has_source FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.place(spark, "csv")
    sinks.csv(roles.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    rows = readers.csv_rows(spark, path, "s_suppkey LONG, s_name STRING, s_acctbal DOUBLE")
    return rows.select("s_suppkey", "s_name", "s_acctbal", F.col("source_csv").endswith(".csv").alias("has_source"))


@query("SELECT n_nationkey::INT AS task, n_nationkey * 1.5 + 1 AS success_rate, NULL::DOUBLE AS reward FROM nation")
def key_value_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Key: number' lines, the last one of each key."""
    root = scratch.place(spark, "values")
    for r in roles.table(spark, sf_dir, "nation").select("n_nationkey").collect():  # 25 rows
        k = r["n_nationkey"]
        sinks.atomic_bytes(f"{root}/task-{k}.txt", f"start\nSuccess Rate: 0.5\nother\nSuccess Rate: {k * 1.5 + 1}\rReward: none\n".encode())
    found = readers.key_values(readers.log_lines(spark, root), ["Success Rate", "Reward"])
    return found.select(F.regexp_extract("file", r"task-(\d+)", 1).cast("int").alias("task"), "success_rate", "reward")


@query("SELECT 's' || n_regionkey AS suite, 't' || n_nationkey AS task, n_nationkey::DOUBLE AS succ_num, 50.0::DOUBLE AS total_num FROM nation")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files with suite and task from their paths."""
    root = scratch.place(spark, "results")
    for r in roles.table(spark, sf_dir, "nation").collect():  # 25 rows
        sinks.atomic_json(f"{root}/s{r['n_regionkey']}/t{r['n_nationkey']}.json", {"succ_num": r["n_nationkey"], "total_num": 50, "succ_rate": r["n_nationkey"] / 50})
    return readers.results(spark, root, r"/(s\d+)/(t\d+)\.json").select("suite", "task", "succ_num", "total_num")


@query("SELECT 'n' || n_regionkey AS task, count(*) FILTER (n_nationkey % 3 = 0) AS succ_num, count(*) AS total_num FROM nation GROUP BY 1")
def rollout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes by folder from the names of the files."""
    root = scratch.place(spark, "rollouts")
    for r in roles.table(spark, sf_dir, "nation").collect():  # 25 rows
        sinks.atomic_bytes(f"{root}/n{r['n_regionkey']}/{r['n_nationkey']}_{r['n_nationkey'] % 3 == 0}.mp4", b"x")
    return readers.rollouts(spark, root)


@query("SELECT p_partkey, 2 AS regions, p_size + 1.0 AS first, p_size - 0.5 AS last FROM part")
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four numbers of a layout description."""
    text = F.format_string("(:regions (a (:ranges ((%d.0 2 -3e1 4)))) (b (1 2 3 %s) (x y)))", F.col("p_size") + 1, (F.col("p_size") - 0.5).cast("string"))
    found = roles.table(spark, sf_dir, "part").select("p_partkey", readers.region_ranges(text).alias("r"))
    return found.select("p_partkey", F.size("r").alias("regions"), F.col("r")[0][0].alias("first"), F.col("r")[1][3].alias("last"))


@query("SELECT 'model' || n_regionkey AS file, 'w' || n_nationkey AS name, 'F32' AS dtype, n_nationkey::BIGINT AS d0, 4::BIGINT AS d1 FROM nation")
def tensor_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, types and shapes from the headers of tensor files."""
    import json
    import struct
    from itertools import groupby

    root = scratch.place(spark, "tensors")
    rows = sorted((r["n_regionkey"], r["n_nationkey"]) for r in roles.table(spark, sf_dir, "nation").collect())  # 25 rows
    for region, own in groupby(rows, lambda r: r[0]):
        head = json.dumps({"__metadata__": {}} | {f"w{k}": {"dtype": "F32", "shape": [k, 4], "data_offsets": [0, 0]} for _, k in own}).encode()
        sinks.atomic_bytes(f"{root}/model{region}.safetensors", struct.pack("<Q", len(head)) + head)
    found = readers.tensor_schema(spark, root)
    return found.select(F.regexp_extract("path", r"(model\d+)", 1).alias("file"), "name", "dtype", F.col("shape")[0].alias("d0"), F.col("shape")[1].alias("d1"))


@query(f"WITH {roles.SLOTS} SELECT (optimizer_step // 3)::BIGINT AS shard, count(*) AS rows, min(optimizer_step) AS first_step, max(optimizer_step) AS last_step, true AS digest FROM slots GROUP BY 1")
def lineage_shard_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in shards of three steps, with the index row of each shard."""
    path = scratch.place(spark, "lineage")
    sinks.lineage_shards(roles.slots(spark, sf_dir), path, 3)
    found = sinks.lineage_index(spark, path)
    return found.select(F.col("shard").cast("long").alias("shard"), "rows", "first_step", "last_step", (scalars.is_sha256("sha256") & (F.col("bytes") > 0)).alias("digest"))


@query("SELECT doc_id AS episode, 0::BIGINT AS segment, 0::BIGINT AS first, n_chars - 1 AS last FROM documents WHERE doc_id % 4 > 0 UNION ALL SELECT doc_id, 7, 5, 9 FROM documents WHERE doc_id % 4 > 1")
def segment_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from nested configs, with defaults where the configs leave something out."""
    kind = "array<struct<segment_id:bigint,start_frame:bigint,end_frame:bigint,action_loss_first:bigint,action_loss_last:bigint>>"
    none = F.lit(None).cast("bigint")

    def config(*values):
        return F.struct(*[v.cast("bigint").alias(n) for v, n in zip(values, ("segment_id", "start_frame", "end_frame", "action_loss_first", "action_loss_last"), strict=True)])

    plain, own = config(none, F.lit(0), F.col("n_chars"), none, none), config(F.lit(7), F.lit(0), F.col("n_chars"), F.lit(5), F.lit(9))
    k = F.col("doc_id") % 4
    configs = F.when(k == 0, F.array().cast(kind)).when(k == 1, F.array(plain)).otherwise(F.array(plain, own))
    rows = roles.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode"), configs.alias("action_config"))
    return selectors.segments_of(rows).select("episode", F.col("segment").cast("long").alias("segment"), "first", "last")


@query("SELECT sum(o_totalprice > 1000)::BIGINT AS succ, count(*) AS total, o_orderstatus AS run FROM orders GROUP BY 3")
def status_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of a stream's running sums."""
    source, target = scratch.place(spark, "status-in"), scratch.place(spark, "status")
    sinks.parquet(roles.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("run"), (F.col("o_totalprice") > 1000).cast("long").alias("succ_num"), F.lit(1).cast("long").alias("total_num")), source)
    stream = spark.readStream.schema("run STRING, succ_num LONG, total_num LONG").parquet(source)
    streams.status_snapshots(stream, target, scratch.place(spark, "status-checkpoint")).awaitTermination()
    rows = readers.jsonl(spark, target, "run STRING, succ LONG, total LONG, batch LONG")
    return rows.groupBy("run").agg(F.max_by("succ", "batch").alias("succ"), F.max_by("total", "batch").alias("total"))


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events) SELECT user_id AS session, event_id AS seq, step, CASE WHEN step < 12 THEN step * 0.5 END AS action FROM c""")
def replay_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replayed recording of twelve steps: the n-th call of a session gets the n-th action."""
    source = scratch.place(spark, "calls")
    sinks.parquet(roles.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq")), source)
    actions = spark.range(12).select(F.col("id").alias("step"), (F.col("id") * 0.5).alias("action"))
    stream = streams.next_action(spark.readStream.schema("session LONG, seq LONG").parquet(source), actions)
    path = scratch.place(spark, "replayed")
    streams.to_parquet(stream, path, scratch.place(spark, "replayed-checkpoint")).awaitTermination()
    return spark.read.parquet(path).select("session", "seq", "step", "action")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def filtered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered data set as a view: nothing is copied."""
    sinks.view(roles.table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0"), "trajspark_filtered")
    return spark.table("trajspark_filtered").select("s_suppkey")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data first, the success marker last, which names what it stands for."""
    path = scratch.place(spark, "published")
    rows = roles.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    sinks.published(rows, path, {"rows": rows.count()})
    marker = sinks.marker_of(path)
    return spark.read.parquet(path).filter(F.lit(marker is not None and marker["rows"] > 0)).select("n_regionkey", "n")


@query("SELECT o_orderkey::VARCHAR AS key, 'unknown' AS rule FROM orders WHERE false UNION ALL SELECT k::VARCHAR, r FROM (VALUES (3, 'repeated'), (-1, 'unknown'), (-1, 'repeated')) v(k, r)")
def id_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit list of ids with repeats and an unknown one."""
    return quality.id_selection(roles.table(spark, sf_dir, "documents"), [3, 3, 1, -1, -1], "doc_id")


@query("SELECT vec_id, embedding[1]::DOUBLE AS a, 0.0::DOUBLE AS b, embedding[2]::DOUBLE AS c, 0.0::DOUBLE AS outside FROM embeddings")
def channel_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels scattered to places of a wider row, and gathered with one outside."""
    wide = scalars.scatter("embedding", {0: 4, 1: 2}, 6)
    rows = roles.table(spark, sf_dir, "embeddings").select("vec_id", wide.alias("w"))
    got = rows.select("vec_id", scalars.gather("w", [4, 3, 2, 99]).alias("g"))
    return got.select("vec_id", *[F.col("g")[i].alias(n) for i, n in enumerate(("a", "b", "c", "outside"))])


@query("SELECT c_custkey, CASE WHEN c_mktsegment ILIKE '%auto%' THEN 'car' WHEN c_mktsegment ILIKE '%house%' THEN 'home' ELSE 'other' END AS guess, 'a.b.' || c_custkey AS parameter, least(9, c_custkey % 13)::INT AS timestep, round(0.1 + c_custkey * 0.01, 9) AS shift FROM customer")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guesses by name, parameter names without wrappers, clamped timesteps, a shift on a line."""
    k = F.col("c_custkey")
    wrapped = F.concat(F.lit("module._fsdp_wrapped_module.module.a._fsdp_wrapped_module.b."), k.cast("string"))
    return roles.table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.name_guess("c_mktsegment", {"auto": "car", "house": "home"}, "other").alias("guess"), scalars.parameter_name(wrapped).alias("parameter"),
        scalars.timestep_id((F.pmod(k, F.lit(13)) + 0.5) / 10.0, 10).alias("timestep"), F.round(scalars.shift_for_length(k, (0.0, 0.1), (100.0, 1.1)), 9).alias("shift"))


@query("SELECT o_orderkey, 2 AS entries, o_custkey AS inner_value, o_orderkey % 7 AS other FROM orders")
def flat_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.create_map(F.lit("a"), F.create_map(F.lit("x"), "o_custkey"), F.lit("b"), F.create_map(F.lit("y"), F.pmod("o_orderkey", F.lit(7))))
    rows = roles.table(spark, sf_dir, "orders").select("o_orderkey", scalars.flatten_map(nested).alias("m"))
    return rows.select("o_orderkey", F.size("m").alias("entries"), F.col("m")["a.x"].alias("inner_value"), F.col("m")["b.y"].alias("other"))


@query("SELECT vec_id, len(embedding)::INT AS size, true AS finite, round(list_min(embedding::DOUBLE[]), 6) AS least, round(list_max(embedding::DOUBLE[]), 6) AS most, round(list_avg(embedding::DOUBLE[]), 6) AS mean FROM embeddings")
def array_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "embeddings").select("vec_id", scalars.array_profile("embedding").alias("p"))
    return rows.select("vec_id", "p.size", "p.finite", *[F.round(F.col(f"p.{c}"), 6).alias(c) for c in ("least", "most", "mean")])


@query(f"WITH {roles.SLOTS} SELECT dataset, count(*) AS n FROM slots WHERE done GROUP BY 1")
def lineage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed records through a sink of shards, counted after the scan."""
    path = scratch.place(spark, "lineage")
    sinks.lineage_shards(lineage.committed(roles.slots(spark, sf_dir)), path, 2)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT s_suppkey AS k, s_nationkey AS task FROM supplier) SELECT (SELECT count(*) FROM l) AS rows, (SELECT count(DISTINCT task) FROM l) AS tasks, 's_suppkey,s_nationkey' AS columns")
def sample_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns and a row of one file; a path that can't be read gives its error instead."""
    path = scratch.place(spark, "profile")
    sinks.parquet(roles.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), path)
    good, bad = readers.profile(spark, path), readers.profile(spark, f"{path}-none")
    columns = ",".join(good["columns"]) if good["row"] and bad["error"] else "?"
    rows = spark.read.parquet(path)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("s_nationkey").alias("tasks")).withColumn("columns", F.lit(columns))


@query("SELECT episode, configs FROM (SELECT doc_id AS episode, doc_id % 4 - (doc_id % 4 > 1)::INT AS configs FROM documents) WHERE configs > 0")
def config_manifest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with only the configs that a manifest names, in their order; emptied episodes go."""
    d = roles.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode"))
    spans = scalars.interval_ids(F.pmod("episode", F.lit(4)))
    config = F.transform(spans, lambda i: F.struct((i * 10).alias("start_frame"), (i * 10 + 10).alias("end_frame")))
    manifest = d.select("episode", F.explode(spans).alias("i")).filter((F.col("i") != 1) | (F.pmod("episode", F.lit(4)) < 2))
    found = selectors.filter_configs(d.withColumn("action_config", config), manifest.select("episode", (F.col("i") * 10).alias("start"), (F.col("i") * 10 + 10).alias("end")))
    return found.select("episode", F.size("action_config").cast("long").alias("configs"))


@query("SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 7 = 0 THEN 'missing_file' ELSE 'digest' END AS rule FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 11 = 0")
def marker_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A success marker against the artifacts that are there."""
    k, name = F.col("s_suppkey"), F.col("s_suppkey").cast("string").alias("name")
    digest = F.sha2(F.col("s_name").cast("binary"), 256)
    rows = roles.table(spark, sf_dir, "supplier")
    marker = rows.select(name, digest.alias("sha256"))
    there = rows.filter(k % 7 != 0).select(name, F.when(k % 11 == 0, F.sha2(F.lit("x"), 256)).otherwise(digest).alias("sha256"))
    return quality.marker_rules(marker, there)


@query("""SELECT p_partkey::VARCHAR AS key, rule FROM (SELECT p_partkey, 'missing' AS rule FROM part WHERE p_partkey % 40 = 1 UNION ALL SELECT p_partkey, 'shape' FROM part WHERE p_partkey % 30 = 2 AND p_partkey % 40 <> 1 UNION ALL SELECT p_partkey, 'empty_state' FROM part WHERE p_partkey % 25 = 3 AND p_partkey % 40 <> 1)""")
def optimizer_state_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two optimizer inventories with planted differences."""
    k = F.col("p_partkey")
    saved = roles.table(spark, sf_dir, "part").select(
        k.alias("parameter_name"), F.lit(0).alias("optimizer_group_index"), k.alias("position_in_group"), F.col("p_brand").alias("parameter_shape"), F.col("p_type").alias("parameter_dtype"),
        (k % 25 != 3).alias("optimizer_state_present"), F.lit(True).alias("has_received_gradient"))
    current = saved.filter("parameter_name % 40 <> 1").withColumn("parameter_shape", F.when(F.col("parameter_name") % 30 == 2, "other").otherwise(F.col("parameter_shape")))
    return quality.optimizer_state_rules(saved, current)


@query("SELECT user_id, t, CASE WHEN t = 0 THEN 0.0 ELSE round(value - v0, 6) END AS dx, 1.0::DOUBLE AS w FROM (SELECT user_id, value, row_number() OVER w - 1 AS t, first_value(value) OVER w AS v0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def relative_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses relative to an episode's first: translation less its start; equal rotations cancel."""
    from ..operators import sequences

    turn = F.array(F.lit(0.6), F.lit(0.8), F.lit(0.0), F.lit(0.0))
    rows = roles.series(spark, sf_dir).select("user_id", "t", F.array("value", F.lit(1.0), F.lit(2.0)).alias("xyz"), turn.alias("q"))
    out = sequences.relative_pose(rows, "xyz", "q", ["user_id"], ["t"])
    moved, turned = out.columns[-2:]
    return out.select("user_id", "t", F.round(F.col(moved)[0], 6).alias("dx"), F.round(F.col(turned)[0], 6).alias("w"))


@query("SELECT n_name AS column_line FROM nation WHERE n_nationkey < 0 UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of a small table as Markdown."""
    text = sinks.markdown(roles.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "Regions")
    return spark.createDataFrame([(line,) for line in text.splitlines()[4:]], "column_line string")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def episode_scan_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table in the role of a scan of records."""
    path = scratch.place(spark, "records")
    sinks.parquet(roles.table(spark, sf_dir, "embeddings"), path)
    return datasets.finite(spark.read.parquet(path).withColumn("l", F.col("label").cast("double")), ["l"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
