"""Sidecar files, views of data sets, latent records and shard summaries over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars
from ..operators import contracts, diff, selectors
from ..sources import artifacts, readers, sinks
from . import roles
from .registry import query


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as episodes, a line item a raw row: quantities in the first channel, line numbers in the second."""
    rows = roles.table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("v"))
    row = lambda *v: F.concat(F.array(*v), F.array_repeat(F.lit(0.0).cast("float"), contracts.ACTION_WIDTH - len(v)))
    own = rows.groupBy(F.col("l_suppkey").alias("k")).agg(F.sort_array(F.collect_list("v")).alias("raw")).withColumn("raw_length", F.size("raw").cast("long"))
    real = F.transform(F.slice("raw", F.lit(1), F.greatest(contracts.real_actions("raw_length"), F.lit(0)).cast("int")), lambda x: row(x["l_quantity"].cast("float"), x["l_linenumber"].cast("float")))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), contracts.ACTION_WIDTH), contracts.ZERO_PREFIX)
    return own.select(
        "k", F.format_string("episode_%06d", "k").alias("name"), "raw_length", F.sha2(F.concat_ws(":", "k", "raw_length"), 256).alias("raw_sha256"), F.concat(zeros, real).alias("action"),
        F.array_repeat(F.lit(0.25).cast("float"), contracts.ANCHOR_WIDTH).alias("anchor"))


def _written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sidecars as files and read again, and their sources; every seventh episode has none."""
    path = scratch.place(spark, "sidecars")
    rows = _sidecars(spark, sf_dir)
    made = rows.filter("k % 7 <> 1").withColumns({"source_length": F.col("raw_length"), "source_sha256": F.col("raw_sha256")})
    artifacts.write_sidecars(made, path)
    return artifacts.read_sidecars(spark, path), rows.select("k", "name", "raw_length", "raw_sha256")


_LINES = """r AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS t, count(*) OVER (PARTITION BY l_suppkey) AS n, l_quantity, l_linenumber FROM lineitem),
e AS (SELECT k, n, (n - 1) // 16 * 16 AS real_action_count, coalesce(sum(l_quantity) FILTER (t <= (n - 1) // 16 * 16), 0)::DOUBLE AS quantities,
  coalesce(sum(l_linenumber * t) FILTER (t <= (n - 1) // 16 * 16), 0)::DOUBLE AS weighted FROM r GROUP BY ALL)"""


@query(f"WITH {_LINES} SELECT printf('episode_%06d', k::BIGINT) AS name, n AS source_length, real_action_count, 16 + real_action_count AS rows, n - real_action_count AS tail_discarded_count, quantities, weighted FROM e WHERE k % 7 <> 1")
def sidecar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action sidecars written as array files behind a commit, and what their arrays hold after the scan."""
    found, _ = _written(spark, sf_dir)
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    ids = F.arrays_zip("action", "source_frame_ids")
    quantities = F.transform("action", lambda r: F.element_at(r, 1).cast("double"))
    weighted = F.transform(ids, lambda x: F.element_at(x["action"], 2).cast("double") * (x["source_frame_ids"] + 1))
    return found.filter("error is null").select(
        "name", "source_length", "real_action_count", F.size("action").cast("long").alias("rows"), "tail_discarded_count", total(quantities).alias("quantities"), total(weighted).alias("weighted"))


@query(f"""WITH {_LINES} SELECT printf('episode_%06d', k::BIGINT) AS key, 'no_sidecar' AS rule FROM e WHERE k % 7 = 1 UNION ALL SELECT printf('episode_%06d', k::BIGINT), 'source_digest' FROM e WHERE k % 5 = 2 AND k % 7 <> 1
UNION ALL SELECT printf('episode_%06d', k::BIGINT), unnest(['source_length', 'tail_discarded_count']) FROM e WHERE k % 6 = 3 AND k % 7 <> 1 AND n % 16 <> 1 AND n % 16 <> 0
UNION ALL SELECT printf('episode_%06d', k::BIGINT), 'source_length' FROM e WHERE k % 6 = 3 AND k % 7 <> 1 AND n % 16 = 1 UNION ALL SELECT printf('episode_%06d', k::BIGINT), 'tail_discarded_count' FROM e WHERE k % 6 = 3 AND k % 7 <> 1 AND n % 16 = 1
UNION ALL SELECT printf('episode_%06d', k::BIGINT), unnest(['source_length', 'tail_discarded_count', 'real_action_count', 'action_shape', 'mask_shape', 'source_frame_ids']) FROM e WHERE k % 6 = 3 AND k % 7 <> 1 AND n % 16 = 0""")
def sidecar_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar files against sources that changed since: other digests, a row more, no file."""
    found, sources = _written(spark, sf_dir)
    k = F.col("k")
    now = sources.withColumns({
        "raw_sha256": F.when(k % 5 == 2, F.sha2(F.lit("new"), 256)).otherwise(F.col("raw_sha256")), "raw_length": F.col("raw_length") + F.when(k % 6 == 3, 1).otherwise(0)})
    return artifacts.sidecar_faults(found, now)


_CONFIGS = """c AS (SELECT s_suppkey AS k, i, i * 100 AS s, i * 100 + 100 AS f FROM supplier, range(0, 3) r(i)),
kept AS (SELECT k, count(*) AS configs FROM c WHERE (k + i) % 3 = 0 AND k % 5 <> 0 GROUP BY 1)"""


@query(f"""WITH {_CONFIGS}, l AS (SELECT l_suppkey AS k, count(*) AS rows, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY 1)
SELECT k AS episode, configs, rows, quantity, (SELECT count(*) FROM kept) AS selected_episodes, (SELECT sum(configs)::BIGINT FROM kept) AS kept_segments, (SELECT count(*) FROM c WHERE k % 5 = 0 AND (k + i) % 3 = 0) AS dropped_manifest_segments FROM kept JOIN l USING (k)""")
def episode_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of a data set by a manifest: own metadata, the source's rows; a manifest's row with other bounds drops out."""
    source, path = scratch.place(spark, "source"), scratch.place(spark, "view")
    chunk = F.floor(F.col("episode") / F.lit(1000)).alias("chunk")
    lines = roles.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("episode"), "l_quantity", "l_extendedprice")
    sinks.parquet(lines.select("*", chunk).repartition("chunk"), source, by=["chunk"])
    bounds = lambda i: F.struct((i * 100).cast("long").alias("start_frame"), (i * 100 + 100).cast("long").alias("end_frame"))
    episodes = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("episode")).select("episode", chunk, F.array(*[bounds(F.lit(i)) for i in range(3)]).alias("action_config"))
    named = episodes.select("episode", F.explode(F.array(*map(F.lit, range(3)))).alias("i")).filter("(episode + i) % 3 = 0")
    manifest = named.select("episode", (F.col("i") * 100).alias("start"), (F.col("i") * 100 + 100 + F.when(F.col("episode") % 5 == 0, 1).otherwise(0)).alias("end"))
    summary = artifacts.write_view(episodes, manifest, {"fps": 30, "chunks_size": 1000}, source, path)
    rows = artifacts.view_rows(spark, path, ["chunk", "episode"], ["l_quantity"]).groupBy("episode").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("double").alias("quantity"))
    own = artifacts.view_episodes(spark, path).select("episode", F.size("action_config").cast("long").alias("configs")).join(rows, "episode")
    return own.select("*", *[F.lit(summary[c]).cast("long").alias(c) for c in ("selected_episodes", "kept_segments", "dropped_manifest_segments")])


_PLANTED = [
    ("latent_shape", 23), ("latent_dtype", 29), ("latent_num_frames", 31), ("latent_height", 37), ("latent_width", 41), ("video_num_frames", 43), ("source_video_num_frames", 47), ("video_height", 53),
    ("video_width", 59), ("text", 61), ("camera_key", 67), ("frame_ids", 71), ("start_frame", 73), ("end_frame", 79), ("fps", 83), ("ori_fps", 89), ("image_stride", 97), ("finite", 101), ("has_text_embedding", 103),
]


@query("WITH d AS (SELECT o_orderkey AS k FROM orders) SELECT k::VARCHAR AS key, 'missing_file' AS rule FROM d WHERE k % 19 = 5 UNION ALL " + " UNION ALL ".join(
    f"SELECT k::VARCHAR, 'differing_{c}' FROM d WHERE k % {n} = 7 AND k % 19 <> 5" for c, n in _PLANTED))
def latent_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes with a latent record each: faults of every field, records without a field, files that are not there."""
    k, n = F.col("o_orderkey"), (5 + F.col("o_orderkey") % 40).cast("int")
    ids = F.transform(scalars.interval_ids(n), lambda i: i * contracts.IMAGE_STRIDE)
    latent = F.floor((n - 1) / F.lit(4)).cast("int") + 1
    rows = roles.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 19 != 5, "there").alias("file"), (n * 4).alias("want_length"), F.concat(F.lit("task "), (k % 9).cast("string")).alias("want_task"), F.lit("left").alias("want_camera"),
        ids.alias("want_frame_ids"), F.lit(30).alias("want_fps"))
    right = {
        "latent_shape": F.array(latent * 196, F.lit(48)), "latent_dtype": F.lit("bfloat16"), "latent_num_frames": latent, "latent_height": F.lit(14), "latent_width": F.lit(14), "video_num_frames": n,
        "source_video_num_frames": n * 4, "video_height": F.lit(224), "video_width": F.lit(224), "text": F.col("want_task"), "camera_key": F.lit("left"), "frame_ids": F.col("want_frame_ids"), "start_frame": F.lit(0),
        "end_frame": n * 4, "fps": F.lit(30), "ori_fps": F.lit(30), "image_stride": F.lit(4), "finite": F.lit(True), "has_text_embedding": F.lit(False),
    }
    wrong = {"latent_shape": F.array(latent * 196, F.lit(16)), "latent_dtype": F.lit("float32"), "frame_ids": F.slice("want_frame_ids", 2, 1000), "finite": F.lit(False), "has_text_embedding": F.lit(True), "text": F.lit("other")}
    return contracts.latent_rules(rows.select("*", *[F.when(k % m != 7, right[c]).otherwise(wrong.get(c)).alias(c) for c, m in _PLANTED]), "o_orderkey")


@query("""SELECT o_orderkey, 'attempts' AS folder FROM orders WHERE o_orderkey % 4 <= o_custkey % 3 UNION ALL SELECT o_orderkey, 'ranks' FROM orders WHERE o_orderkey % 4 = 3""")
def shard_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that summaries list, in a folder with summaries of attempts (those of whole ranks are older and don't count) and in one that only has the latter."""
    root = scratch.place(spark, "discovery")
    orders = roles.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("rank"), (F.col("o_orderkey") % 4).alias("file"))
    sinks.parquet(orders.repartition("rank", "file"), f"{root}/data", by=["rank", "file"])
    shards = lambda rank, files: {"rank": rank, "shards": [{"path": f"{root}/data/rank={rank}/file={i}", "sha256": ""} for i in files]}
    for rank in range(3):
        sinks.atomic_json(f"{root}/attempts/lineage_rank{rank}_a1_summary.json", shards(rank, range(rank + 1)))
        for folder in ("attempts", "ranks"):
            sinks.atomic_json(f"{root}/{folder}/lineage_rank{rank}_summary.json", shards(rank, [3]))
    found = [spark.read.parquet(*sorted(r["path"] for r in readers.shard_files(spark, f"{root}/{f}").collect())).select("o_orderkey", F.lit(f).alias("folder")) for f in ("attempts", "ranks")]  # a path a shard
    return found[0].unionByName(found[1])


@query("""SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"lines":[' || (o_orderkey % 3) || ',null],"none":' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"x"' END || ',"price":' || o_totalprice::DOUBLE::VARCHAR
  || ',"status":{"a":"' || o_orderstatus || '","b":' || CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END || '},"word":"\\u00e9"}') AS digest FROM orders""")
def payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of payloads with nested, floating-point, null and other than ASCII values."""
    k = F.col("o_orderkey")
    payload = F.struct(
        F.lit("\u00e9").alias("word"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_custkey").alias("customer"), F.when(k % 2 == 1, "x").alias("none"),
        F.array((k % 3).cast("long"), F.lit(None).cast("long")).alias("lines"), F.struct((k % 5 == 0).alias("b"), F.col("o_orderstatus").alias("a")).alias("status"))
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload")).select("o_orderkey", scalars.payload_hash("payload").alias("digest"))


@query("""WITH d AS (SELECT doc_id AS e, n_chars AS n FROM documents), c AS (SELECT e, n, 0 AS place, 0 AS s, n + 5 AS f, NULL AS id, NULL AS last FROM d UNION ALL SELECT e, n, 1, 8, 30 + e % 7, e, 20 FROM d WHERE e % 2 = 0)
SELECT e AS episode, coalesce(id, place)::BIGINT AS segment, s::BIGINT AS start, f::BIGINT AS "end", s::BIGINT AS first, coalesce(last, least(f, n) - 1)::BIGINT AS last, len(range(s, f, 4))::BIGINT AS frames, list_max(range(s, f, 4))::BIGINT AS last_frame,
  (coalesce(last, least(f, n) - 1) - s + 1)::BIGINT AS real_action_count, place = 1 AND e % 3 = 0 AS contains_success_tail FROM c""")
def segment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with all fields, from configs that leave out most of them and reach over the episode's end."""
    k, none = F.col("doc_id"), F.lit(None)

    def config(segment, start, end, last, tail):
        values = {"segment_id": segment, "start_frame": start, "end_frame": end, "action_loss_last": last}
        return F.struct(*[v.cast("bigint").alias(n) for n, v in values.items()], tail.cast("boolean").alias("contains_success_tail"))

    plain, own = config(none, F.lit(0), F.col("n_chars") + 5, none, none), config(k, F.lit(8), 30 + k % 7, F.lit(20), k % 3 == 0)
    rows = roles.table(spark, sf_dir, "documents").select(k.alias("episode"), F.col("n_chars").alias("length"), F.when(k % 2 == 0, F.array(plain, own)).otherwise(F.array(plain)).alias("action_config"))
    return selectors.segment_fields(rows).select(
        "episode", "segment", "start", "end", "first", "last", F.size("frame_ids").cast("long").alias("frames"), F.array_max("frame_ids").alias("last_frame"), "real_action_count", "contains_success_tail")


_STATE = list(diff.BUNDLE_FIELDS)


@query(f"""WITH p AS (SELECT p_partkey AS k, [{', '.join(f"CASE WHEN p_partkey % {17 + n} = 3 THEN '{f}' END" for n, f in enumerate(_STATE))}] AS f FROM part WHERE p_partkey % 50 <> 4 AND p_partkey % 60 <> 5),
c AS (SELECT printf('%09d', k::BIGINT) || ':' || array_to_string(list_filter(f, lambda x: x IS NOT NULL), '+') AS t, k FROM p WHERE len(list_filter(f, lambda x: x IS NOT NULL)) > 0)
SELECT (SELECT count(*) FROM part WHERE p_partkey % 50 = 4 AND p_partkey % 60 <> 5) AS missing, (SELECT count(*) FROM part WHERE p_partkey % 60 = 5 AND p_partkey % 50 <> 4) AS extra, (SELECT count(*) FROM c) AS state_mismatch_count, false AS equal,
  (SELECT string_agg(t, ',' ORDER BY k) FROM (SELECT * FROM c ORDER BY k LIMIT 20)) AS examples""")
def inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimizer state of parts before and after, with each of the twelve fields changed in some."""
    k = F.col("p_partkey")
    rows = roles.table(spark, sf_dir, "part").select(k, F.format_string("%09d", k).alias("parameter_name"), *[F.concat(F.lit(f), (k % 7).cast("string")).alias(f) for f in _STATE])
    after = rows.withColumns({f: F.when(k % (17 + n) == 3, "other").otherwise(F.col(f)) for n, f in enumerate(_STATE)})
    return diff.inventory_report(rows.filter("p_partkey % 60 <> 5"), after.filter("p_partkey % 50 <> 4"), fields=diff.BUNDLE_FIELDS)


@query("""WITH r AS (SELECT user_id % 8 AS rank, event_id AS micro, value FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY micro) AS place, count(*) OVER (PARTITION BY rank) AS n FROM r)
SELECT rank, place, CASE WHEN place > n - 2 AND rank = 3 THEN 'missing' ELSE 'changed' END AS status FROM n WHERE (place > n - 2 AND rank = 3) OR micro % 41 = 6""")
def signature_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of two attempts that differ in what an attempt records, in some contents and in length."""
    base = roles.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("rank"), F.col("event_id").alias("microbatch_id"), F.floor(F.col("event_id") / 4).alias("optimizer_step"), (F.col("event_id") % 4).alias("gradient_accumulation_index"), F.col("value").alias("items"))
    left = base.withColumns({"attempt_id": F.lit("a1"), "path": F.lit("/one")})
    last = base.filter("rank = 3").orderBy(F.desc("microbatch_id")).limit(2).select("microbatch_id")  # two rows
    right = base.join(F.broadcast(last), "microbatch_id", "left_anti").withColumns({"attempt_id": F.lit("a2"), "path": F.lit("/two"), "items": F.when(F.col("microbatch_id") % 41 == 6, F.col("items") + 1).otherwise(F.col("items"))})
    return diff.compare_signatures(left, right, ["items"])


_FILES = {"data_manifest": "data_manifest.json", "action_stats": "action_stats_v1.json"}


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), m AS (SELECT k FROM s WHERE k % 23 <> 8)
SELECT k::VARCHAR AS key, 'no_setup' AS rule FROM s WHERE k % 23 = 8 UNION ALL SELECT k::VARCHAR, 'other_output' FROM m WHERE k % 7 = 1 UNION ALL SELECT k::VARCHAR, 'overlapping_roots' FROM m WHERE k % 9 = 2 UNION ALL SELECT k::VARCHAR, 'other_model' FROM m WHERE k % 11 = 3 UNION ALL
SELECT k::VARCHAR, 'episode_count' FROM m WHERE k % 13 = 4 UNION ALL SELECT k::VARCHAR, 'task_count' FROM m WHERE k % 15 = 5 UNION ALL SELECT k::VARCHAR, 'repeated_episode' FROM m WHERE k % 17 = 6 UNION ALL SELECT k::VARCHAR, 'repeated_task' FROM m WHERE k % 19 = 7 UNION ALL
SELECT k::VARCHAR, 'unexpected_action_stats' FROM m WHERE k % 6 = 0 UNION ALL SELECT k::VARCHAR, 'missing_data_manifest' FROM m WHERE k % 10 = 9 UNION ALL SELECT k::VARCHAR, 'digest_action_stats' FROM m WHERE k % 8 = 3""")
def setup_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as setups whose roots, counts, lists or artifacts went stale."""
    k = F.col("s_suppkey")
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    s = roles.table(spark, sf_dir, "supplier").select(k)
    requests = s.select(k.alias("setup"), text("/out/").alias("output_root"), F.lit("/models/a").alias("model_root"))
    ids = F.when(k % 17 == 6, F.array(k, k)).otherwise(F.array(k, k + 1))
    tasks = F.when(k % 19 == 7, F.array(F.lit("t"), F.lit("t"))).otherwise(F.array(F.lit("t"), F.lit("u")))
    digest = F.sha2(k.cast("string"), 256)
    setups = s.filter("s_suppkey % 23 <> 8").select(
        k.alias("setup"), F.when(k % 7 == 1, F.lit("/out/else")).otherwise(text("/out/")).alias("output_root"), F.when(k % 9 == 2, F.concat(text("/out/"), F.lit("/raw"))).otherwise(text("/raw/")).alias("source_root"),
        F.when(k % 11 == 3, "/models/b").otherwise("/models/a").alias("model_root"), ids.alias("selected_episodes"), (F.size(ids) + F.when(k % 13 == 4, 1).otherwise(0)).alias("selected_episode_count"),
        tasks.alias("tasks"), (F.size(tasks) + F.when(k % 15 == 5, 1).otherwise(0)).alias("task_count"),
        F.create_map(F.lit("data_manifest"), F.lit(_FILES["data_manifest"]), F.lit("action_stats"), F.when(k % 6 == 0, "old.json").otherwise(_FILES["action_stats"]), F.lit("data_manifest_sha256"), digest, F.lit("action_stats_sha256"), digest).alias("artifacts"))
    files = s.select(k.alias("setup"), F.explode(F.array(*map(F.lit, _FILES.values()))).alias("name"), digest.alias("sha256"))
    stats = F.col("name") == _FILES["action_stats"]
    files = files.filter(stats | (F.col("setup") % 10 != 9)).withColumn("sha256", F.when(stats & (F.col("setup") % 8 == 3), F.sha2(F.lit("new"), 256)).otherwise(F.col("sha256")))
    return contracts.setup_rules(setups, requests, files, _FILES)
