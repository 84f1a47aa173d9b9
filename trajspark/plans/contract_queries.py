"""Contracts of overlays, audits by recomputation, reach of configs, nearest values and rotations over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import audit, contracts, intervals, lineage, overlay, quality, sequences
from . import roles
from .registry import query

POLICY = overlay.Policy("overlay-1", 4096)
_BLOCKS = POLICY.max_segment_frames - 1
_COUNTS = ["parent_episodes", "split_episodes", "segments", "source_latent_frames", "virtual_segment_frames", "real_action_rows", "zero_prefix_rows", "training_action_rows", "total_padded_self_tokens"]


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as episodes, an event a block; two cameras, that of some a frame longer."""
    return roles.lengths(spark, sf_dir).select(F.col("episode").alias("episode_index"), (F.col("length") + 1).alias("latent_frames"))


def _overlay(parents: DataFrame) -> DataFrame:
    """A planned overlay with a fault of each kind in some of the episodes."""
    planned = sequences.plan_segments(parents, "latent_frames", POLICY.max_self_tokens, ["episode_index"])
    m, o = F.pmod("episode_index", F.lit(10)), F.col("ordinal")
    last = o == F.floor((F.col("latent_frames") - 2) / F.lit(_BLOCKS))
    rows = planned.filter(~((m == 3) & last) & (F.pmod("episode_index", F.lit(20)) != 8))
    rows = rows.withColumns({
        "real_block_start": F.col("start") + F.when((m == 1) & (o == 1), 1).otherwise(0), "real_block_end": F.col("stop") + F.when((m == 2) & (o == 0), 2).otherwise(0),
        "segment_ordinal": F.when((m == 6) & (o == 1), F.lit(0)).otherwise(o),
    })
    frames = F.col("real_block_end") - F.col("real_block_start") + 1
    rows = rows.withColumns({
        "frame_count": frames, "token_count": scalars.episode_tokens(frames) + F.when((m == 4) & (o == 1), 128).otherwise(0),
        "latent_start": F.col("real_block_start"), "latent_stop": F.col("real_block_end") + 1,
        "real_action_row_start": F.col("real_block_start") * 16, "real_action_row_end": F.col("real_block_end") * 16,
        "segment_joint_anchor": F.array_repeat(F.lit(0.5), 12), "segment_action_sha256": F.sha2(F.concat_ws(":", "episode_index", "ordinal"), 256),
        "segment_base_anchor": F.array(F.lit(0.0), F.lit(0.0), F.when((F.pmod("episode_index", F.lit(20)) == 9) & (o == 0), F.lit(float("nan"))).otherwise(F.lit(1.0))),
        "segment_index": F.col("episode_index") * 10000 + o,
    })
    key = overlay.sample_key(POLICY)
    return rows.withColumn("sample_key", F.when((m == 5) & (o == 0), F.concat(key, F.lit("x"))).otherwise(key))


_OVERLAY = f"""p AS (SELECT user_id AS e, count(*) AS blocks FROM events GROUP BY 1),
s0 AS (SELECT e, blocks, unnest(range(0, (blocks + {_BLOCKS - 1}) // {_BLOCKS})) AS o FROM p WHERE e % 20 <> 8),
s1 AS (SELECT e, blocks, o, o * {_BLOCKS} + CASE WHEN e % 10 = 1 AND o = 1 THEN 1 ELSE 0 END AS a, least(o * {_BLOCKS} + {_BLOCKS}, blocks) + CASE WHEN e % 10 = 2 AND o = 0 THEN 2 ELSE 0 END AS b,
  CASE WHEN e % 10 = 6 AND o = 1 THEN 0 ELSE o END AS ord FROM s0 WHERE NOT (e % 10 = 3 AND o = (blocks - 1) // {_BLOCKS})),
s AS (SELECT *, (e * 10000 + o) AS id, b - a + 1 AS frames, (424 * (b - a + 1) + 127) // 128 * 128 + CASE WHEN e % 10 = 4 AND o = 1 THEN 128 ELSE 0 END AS tokens FROM s1),
d AS (SELECT e, x, count(*) FILTER (k = 1) - count(*) FILTER (k = 2) AS depth, bool_or(k = 2) AS own FROM (
  SELECT e, unnest(range(a, b)) AS x, 1 AS k FROM s WHERE a < b UNION ALL SELECT e, unnest(range(0, blocks)), 2 FROM p) GROUP BY ALL),
f AS (SELECT *, x - row_number() OVER (PARTITION BY e, depth, own ORDER BY x) AS island FROM d WHERE depth <> 0),
n AS (SELECT e, count(*) AS n, count(DISTINCT ord) AS d, min(ord) AS low, max(ord) AS high, sum(frames) AS frames, sum(tokens) AS tokens FROM s GROUP BY 1),
t AS (SELECT count(*) AS parent_episodes, count(*) FILTER (n > 1) AS split_episodes, sum(n)::BIGINT AS segments, sum(blocks + 1)::BIGINT AS source_latent_frames, sum(frames)::BIGINT AS virtual_segment_frames,
  sum(blocks * 16)::BIGINT AS real_action_rows, sum(n * 16)::BIGINT AS zero_prefix_rows, sum(n * 16 + blocks * 16)::BIGINT AS training_action_rows, sum(tokens)::BIGINT AS total_padded_self_tokens FROM n JOIN p USING (e)),
g AS (SELECT sum(blocks)::BIGINT * 16 AS real_action_rows, sum((blocks + {_BLOCKS - 1}) // {_BLOCKS})::BIGINT AS segments, count(*) AS parent_episodes FROM p)"""


@query(f"""WITH {_OVERLAY}
SELECT id::VARCHAR AS key, 'blocks_over_budget' AS rule FROM s WHERE b - a > {_BLOCKS} UNION ALL SELECT id::VARCHAR, 'bounds' FROM s WHERE a >= b UNION ALL
SELECT id::VARCHAR, 'token_count' FROM s WHERE tokens <> (424 * frames + 127) // 128 * 128 UNION ALL SELECT id::VARCHAR, 'tokens_over_budget' FROM s WHERE tokens > {POLICY.max_self_tokens} UNION ALL
SELECT id::VARCHAR, 'sample_key' FROM s WHERE e % 10 = 5 AND o = 0 UNION ALL SELECT id::VARCHAR, 'base_anchor' FROM s WHERE e % 20 = 9 AND o = 0 UNION ALL
SELECT e::VARCHAR, 'ordinals_not_dense' FROM n WHERE d <> n OR low <> 0 OR high <> n - 1 UNION ALL
SELECT x.id::VARCHAR, 'next_starts_elsewhere' FROM s x JOIN s y ON x.e = y.e AND x.ord + 1 = y.ord WHERE y.a <> x.b UNION ALL
SELECT e || ':' || min(x) || '-' || (max(x) + 1), CASE WHEN depth < 0 THEN 'gap' WHEN own THEN 'overlap' ELSE 'outside' END FROM f GROUP BY e, depth, own, island UNION ALL
SELECT e::VARCHAR, 'parent_without_segment' FROM p WHERE e NOT IN (SELECT e FROM s) UNION ALL
SELECT 'manifest:segments', 'total' FROM g, t WHERE g.segments <> t.segments UNION ALL SELECT 'manifest:parent_episodes', 'total' FROM g, t WHERE g.parent_episodes <> t.parent_episodes UNION ALL
SELECT 'manifest:real_action_rows', 'total' FROM g, t WHERE g.real_action_rows <> t.real_action_rows UNION ALL
SELECT 'manifest:' || c, 'total' FROM (SELECT unnest({[c for c in _COUNTS if c not in ('segments', 'parent_episodes', 'real_action_rows')]}) AS c) UNION ALL
SELECT e::VARCHAR, 'differing_frames' FROM p WHERE e % 10 = 7""")
def overlay_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of an overlay: geometry, order, gaps and overlaps of its parents, totals against a manifest that has only three of them, cameras."""
    parents = _parents(spark, sf_dir)
    whole = sequences.plan_segments(parents, "latent_frames", POLICY.max_self_tokens, ["episode_index"])
    planned = whole.agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("episode_index").alias("parent_episodes"), F.sum(F.col("stop") - F.col("start")).alias("b"))
    entry = lambda name, value: F.struct(F.lit("manifest").alias("source"), F.lit(name).alias("name"), value.alias("value"))
    recorded = planned.select(F.explode(F.array(
        entry("segments", F.col("segments")), entry("parent_episodes", F.col("parent_episodes")), entry("real_action_rows", F.col("b") * 16))).alias("r")).select("r.*")
    cameras = parents.select("episode_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("camera"), "latent_frames").withColumn(
        "frames", F.col("latent_frames") + F.when((F.pmod("episode_index", F.lit(10)) == 7) & (F.col("camera") == 1), 1).otherwise(0))
    return overlay.overlay_rules(_overlay(parents), parents, recorded, POLICY).unionByName(quality.agreement(cameras, "episode_index", ["frames"]))


@query(f"WITH {_OVERLAY} SELECT 'x' AS source, c AS name, v AS value FROM (UNPIVOT t ON {', '.join(_COUNTS)} INTO NAME c VALUE v)")
def overlay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _parents(spark, sf_dir)
    return overlay.totals(_overlay(parents), parents).select(F.lit("x").alias("source"), "name", "value")


_RAW = """raw AS (SELECT l_suppkey AS episode, l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS price, l_partkey, l_orderkey FROM lineitem),
side AS (SELECT episode, count(*) AS rows, sum(('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey)), 1, 8))::BIGINT)::BIGINT AS checksum, min(quantity) AS quantity_min, max(quantity) AS quantity_max FROM raw GROUP BY 1),
lng AS (SELECT 'price' AS channel, price AS x FROM raw UNION ALL SELECT 'quantity', quantity FROM raw),
stat AS (SELECT channel, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.99) AS high FROM lng GROUP BY 1)"""


@query(f"""WITH {_RAW}
SELECT 'sidecar' AS level, episode::VARCHAR AS key, 'rows' AS field, rows::DOUBLE AS derived FROM side WHERE episode % 17 = 3 AND episode % 23 <> 5 UNION ALL
SELECT 'sidecar', episode::VARCHAR, 'checksum', checksum::DOUBLE FROM side WHERE episode % 19 = 4 AND episode % 23 <> 5 UNION ALL
SELECT 'sidecar', episode::VARCHAR, 'quantity_max', quantity_max FROM side WHERE episode % 29 = 6 AND episode % 23 <> 5 UNION ALL
SELECT 'sidecar', episode::VARCHAR, 'missing', NULL FROM side WHERE episode % 23 = 5 UNION ALL
SELECT 'sidecar', (-1 - episode)::VARCHAR, 'unknown', NULL FROM side WHERE episode % 31 = 7 AND episode % 23 <> 5 UNION ALL
SELECT 'statistics', channel, 'high', round(high, 6) FROM stat WHERE channel = 'price' UNION ALL SELECT 'statistics', channel, 'low', round(low, 6) FROM stat WHERE channel = 'price' UNION ALL
SELECT 'statistics', channel, 'n', n FROM stat WHERE channel = 'quantity' UNION ALL SELECT 'statistics', channel, 'mean', round(mean, 6) FROM stat WHERE channel = 'quantity' UNION ALL
SELECT 'totals', 'rows', 'value', sum(rows) FROM side UNION ALL SELECT 'totals', 'checksum', 'value', sum(checksum) FROM side""")
def recompute_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars, statistics and totals derived again from raw rows against records with faults at all three levels; small deviations of statistics are borne."""
    raw = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("episode"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), "l_partkey", "l_orderkey")
    side = audit.sidecars(raw, "episode", ["quantity"], ["l_orderkey", "l_partkey"])
    stat = audit.statistics(raw, ["quantity", "price"])
    total = audit.roll_up(side)
    e = F.col("episode")
    off = lambda k, r, by: F.when(F.pmod(e, F.lit(k)) == r, by).otherwise(0)
    kept = side.filter("episode % 23 <> 5")
    wrong_side = kept.withColumns({"rows": F.col("rows") + off(17, 3, 1), "checksum": F.col("checksum") + off(19, 4, 1), "quantity_max": F.col("quantity_max") + off(29, 6, 1)})
    wrong_side = wrong_side.unionByName(kept.filter("episode % 31 = 7").withColumn("episode", (-1 - e).cast("long")))
    price, quantity = F.col("channel") == "price", F.col("channel") == "quantity"
    wrong_stat = stat.withColumns({
        "high": F.when(price, F.col("high") * 1.01).otherwise(F.col("high")), "low": F.when(price, F.lit(None)).otherwise(F.col("low")), "n": F.when(quantity, F.col("n") - 1).otherwise(F.col("n")),
        "mean": F.when(quantity, F.col("mean") * 1.0001).otherwise(F.col("mean")), "std": F.col("std") * (1 + 1e-13),
    })
    wrong_total = total.withColumn("value", F.col("value") + F.when(F.col("name") == "episodes", 0).otherwise(1))
    found = audit.audit([
        audit.Level("sidecar", wrong_side, side, ["episode"], ["rows", "checksum", "quantity_min", "quantity_max"]),
        audit.Level("statistics", wrong_stat, stat, ["channel"], ["n", "mean", "std", "low", "high", "not_finite"], {c: 1e-9 for c in ("mean", "std", "low", "high")}),
        audit.Level("totals", wrong_total, total, ["name"], ["value"]),
    ])
    return found.withColumn("derived", F.round(F.col("derived").cast("double"), 6))


_REACH = f"""{roles.SEGMENTS},
c AS (SELECT episode, segment, start + segment % 3 AS f0, fin, 1 + segment % 2 AS stride, CASE WHEN segment % 4 = 3 THEN 'odd' ELSE 'task' END AS task FROM segs),
k AS (SELECT *, CASE WHEN f0 > fin - 1 THEN 0 ELSE (fin - 1 - f0) // stride + 1 END AS n FROM c),
r AS (SELECT episode, task, f0, least(greatest(fin - f0, 0), ((n - 1) // 4 + 1) * stride * 4 - stride * 4) AS needed FROM k WHERE n >= 2)"""


@query(f"WITH {_REACH} SELECT 'd' AS dataset, task, episode, count(DISTINCT x) AS support FROM (SELECT episode, task, unnest(range(f0, f0 + needed)) AS x FROM r) GROUP BY ALL")
def support_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that nested configs can reach, counted by interval unions."""
    start, segment = F.col("start") + F.pmod("segment", F.lit(3)), F.col("segment")
    frames = F.when(start <= F.col("end") - 1, F.sequence(start, F.col("end") - 1, (1 + F.pmod(segment, F.lit(2))).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    config = F.struct(F.col("start").alias("start_frame"), F.col("end").alias("end_frame"), F.when(F.pmod(segment, F.lit(4)) == 3, F.lit("odd")).alias("action_text"), frames.alias("frame_ids"))
    episodes = roles.segments(spark, sf_dir).groupBy("episode").agg(F.collect_list(config).alias("action_config")).select(
        F.lit("d").alias("dataset"), "episode", F.array(F.lit("task")).alias("tasks"), "action_config")
    return lineage.support_size(episodes)


@query("""WITH b AS (SELECT i AS step, 1.0::DOUBLE - i / 1000.0::DOUBLE AS s FROM range(0, 1000) r(i)), g AS (SELECT step, 5.0::DOUBLE * s / (1 + 4.0::DOUBLE * s) * 1000 AS timestep FROM b)
SELECT event_id, (SELECT arg_min(step, (abs(timestep - value * 7), step)) FROM g) AS step FROM events""")
def nearest_timestep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step of a noise schedule whose timestep is nearest to each event's value; of two as near, the earlier step, which is the greater timestep."""
    asked = roles.table(spark, sf_dir, "events").select("event_id", (F.col("value") * 7).alias("x"))
    return intervals.nearest(asked, scalars.schedule(spark, 1000, 5.0), "x", "timestep", ["step"], ties="high").select("event_id", "step")


def _rotations_sql() -> str:
    names = ", ".join(f"('{c}', {', '.join(str('xyz'.index(a)) for a in c[1:])}, {str(c[0] == 's').lower()})" for c in vectors.CONVENTIONS)
    turn = lambda axis, angle: f"[cos({angle} / 2), {', '.join(f'CASE WHEN {axis} = {n} THEN sin({angle} / 2) ELSE 0 END' for n in range(3))}]"

    def product(p: str, q: str) -> str:
        terms = [[(1, 1, 1), (-1, 2, 2), (-1, 3, 3), (-1, 4, 4)], [(1, 1, 2), (1, 2, 1), (1, 3, 4), (-1, 4, 3)], [(1, 1, 3), (-1, 2, 4), (1, 3, 1), (1, 4, 2)], [(1, 1, 4), (1, 2, 3), (-1, 3, 2), (1, 4, 1)]]
        return "[" + ", ".join(" + ".join(f"({s} * {p}[{a}] * {q}[{b}])" for s, a, b in row) for row in terms) + "]"

    return f"""WITH c(convention, i, j, k, fixed) AS (VALUES {names}),
a AS (SELECT p_partkey, p_partkey % 61 * 0.1 - 3.0 AS u, p_size * 0.06 - 1.4 AS v, p_partkey % 7 * 0.4 - 1.2 AS w FROM part),
t AS (SELECT convention, {turn('i', 'u')} AS p, {turn('j', 'v')} AS q, {turn('k', 'w')} AS r, fixed FROM a, c),
m AS (SELECT convention, CASE WHEN fixed THEN {product('q', 'p')} ELSE {product('p', 'q')} END AS pq, r, fixed FROM t),
z AS (SELECT convention, CASE WHEN fixed THEN {product('r', 'pq')} ELSE {product('pq', 'r')} END AS q FROM m)
SELECT convention, round(sum(q[1]), 4) AS w, round(sum(q[2]), 4) AS x, round(sum(q[3]), 4) AS y, round(sum(q[4]), 4) AS z, count(*) AS turns, count(*) AS restored FROM z GROUP BY 1"""


@query(_rotations_sql())
def rotation_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three angles of each part by all 24 conventions as quaternions, and how many come back from their matrix as the same turn."""
    k, u, v, w, n = map(F.col, ("p_partkey", "u", "v", "w", "n"))
    # parts with the same angles turn the same way: each triple of angles is turned once, and counts as often as parts have it
    alike = roles.table(spark, sf_dir, "part").groupBy(F.pmod(k, F.lit(61)).alias("u"), F.col("p_size").alias("v"), F.pmod(k, F.lit(7)).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    angles = F.array(u * 0.1 - 3.0, v * 0.06 - 1.4, w * 0.4 - 1.2)
    triples = alike.select(angles.alias("angles"), "n").repartition(spark.sparkContext.defaultParallelism)  # few bytes, but much work a row
    rows = triples.select("angles", "n", F.explode(F.lit(vectors.CONVENTIONS)).alias("convention"))
    turned = rows.withColumn("q", vectors.angles_to_quaternion("angles", F.col("convention")))
    back = turned.withColumn("b", vectors.quaternion_to_angles("q", F.col("convention"))).withColumn("r", vectors.angles_to_quaternion("b", F.col("convention")))
    same = F.abs(F.abs(vectors.dot("q", "r")) - 1) < 1e-9
    return back.groupBy("convention").agg(
        *[F.round(F.sum(F.col("q")[i] * n), 4).alias(name) for i, name in enumerate("wxyz")], F.sum("n").alias("turns"), F.sum(F.when(same, n).otherwise(0)).alias("restored"))


@query("""WITH r AS (SELECT s_suppkey AS k, s_suppkey % 13 = 1 AS gone, s_suppkey % 11 = 2 AS twice, s_suppkey % 7 = 3 AS fp, s_suppkey % 5 = 4 AS world, s_suppkey % 17 = 5 AS old FROM supplier)
SELECT k::VARCHAR AS key, 'no_state' AS rule FROM r WHERE gone UNION ALL SELECT (-1 - k)::VARCHAR, 'no_run' FROM r WHERE k % 19 = 6 UNION ALL SELECT k::VARCHAR, 'repeated_state' FROM r WHERE twice AND NOT gone UNION ALL
SELECT k::VARCHAR, 'differing_dataset_fingerprint' FROM r WHERE fp AND NOT gone UNION ALL SELECT k::VARCHAR, 'differing_world_size' FROM r WHERE world AND NOT gone UNION ALL SELECT k::VARCHAR, 'differing_accumulation' FROM r WHERE old AND NOT gone""")
def resume_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as runs against states saved before: other data, another number of ranks, a field the state doesn't have yet, states that are missing, repeated or of no run."""
    k = F.col("s_suppkey")
    when = lambda n, r: F.pmod(k, F.lit(n)) == r
    runs = roles.table(spark, sf_dir, "supplier").select(
        k.alias("run"), k, F.sha2(F.col("s_nationkey").cast("string"), 256).alias("dataset_fingerprint"), F.lit(8).alias("world_size"), F.lit(4).alias("accumulation"))
    saved = runs.filter(~when(13, 1)).withColumns({
        "dataset_fingerprint": F.when(when(7, 3), F.sha2(F.lit("other"), 256)).otherwise(F.col("dataset_fingerprint")), "world_size": F.when(when(5, 4), 4).otherwise(8),
        "accumulation": F.when(~when(17, 5), 4)})
    saved = saved.unionByName(saved.filter(when(11, 2))).unionByName(runs.filter(when(19, 6)).withColumn("run", -1 - k))
    return contracts.resume_rules(saved, runs, "run", ["dataset_fingerprint", "world_size", "accumulation"])
