"""Budgeted selection, coverage, evaluation and packing over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import evaluation, packing, selectors
from . import roles
from .registry import query

BUDGET, BINS = 0.25, 10
_KEYFRAMES = "kf AS (SELECT user_id AS episode, t AS frame FROM series WHERE event_type = 'purchase' AND event_id % 4 = 0)"


def _keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.series(spark, sf_dir).filter((F.col("event_type") == "purchase") & (F.pmod("event_id", F.lit(4)) == 0))
    return rows.select(F.col("user_id").alias("episode"), F.col("t").alias("frame"))


def _greedy_sql(order: str, source: str = "segs") -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {source}),
racts AS (SELECT episode, rank, unnest(generate_series(first, last)) AS action FROM ranked),
firsts AS (SELECT episode, action, min(rank) AS rank FROM racts GROUP BY 1, 2), new AS (SELECT rank, count(*) AS n FROM firsts GROUP BY 1),
cum AS (SELECT r.*, coalesce(sum(coalesce(new.n, 0)) OVER (ORDER BY r.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked r LEFT JOIN new USING (rank)),
tgt AS (SELECT greatest(1, ceil(count(DISTINCT (episode, action)) * {BUDGET})) AS target FROM acts),
kept AS (SELECT cum.* FROM cum, tgt WHERE before < target)"""


@query(f"WITH {roles.SEGMENTS}, {_greedy_sql('motion_score DESC, episode, segment')} SELECT episode, segment::INT AS segment, rank, motion_score FROM kept")
def greedy_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion-ranked segments up to a quarter of the distinct actions."""
    chosen = selectors.select("motion_gripper", roles.segments(spark, sf_dir), BUDGET)
    return chosen.select("episode", "segment", "rank", "motion_score")


@query(f"WITH {roles.SEGMENTS}, t AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY segment) AS turn FROM segs) SELECT episode, segment::INT AS segment, row_number() OVER (ORDER BY turn, episode) AS rank FROM t")
def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.round_robin(roles.segments(spark, sf_dir), [F.col("segment")]).select("episode", "segment", "rank")


_UNIFORM = f"""num AS (SELECT *, count(*) OVER (PARTITION BY episode) AS n, row_number() OVER (PARTITION BY episode ORDER BY segment) - 1 AS i FROM segs),
cnt AS (SELECT DISTINCT episode, n, greatest(1, ceil(n * {BUDGET}))::BIGINT AS c FROM num), pk AS (SELECT episode, n, c, unnest(generate_series(0, c - 1)) AS k FROM cnt),
pick AS (SELECT episode, k, CASE WHEN c = 1 THEN n // 2 ELSE round_even(k * (n - 1) / (c - 1), 0)::BIGINT END AS i FROM pk), uni AS (SELECT num.*, pick.k FROM num JOIN pick USING (episode, i))"""


@query(f"WITH {roles.SEGMENTS}, {_UNIFORM} SELECT episode, segment::INT AS segment, k AS pick FROM uni")
def uniform_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.uniform_picks(roles.segments(spark, sf_dir), BUDGET).select("episode", "segment", "pick")


@query(f"WITH {roles.SEGMENTS}, {_UNIFORM}, turns AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY k) AS turn FROM uni), {_greedy_sql('turn, episode', 'turns')} SELECT episode, segment::INT AS segment, rank FROM kept")
def uniform_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selectors.select("uniform", roles.segments(spark, sf_dir), BUDGET).select("episode", "segment", "rank")


_EVENTS = f"""{_KEYFRAMES}, st AS (SELECT episode, unnest([0, length // 3, 2 * length // 3, length - 1]) AS frame FROM len),
sc AS (SELECT s.*, EXISTS (SELECT 1 FROM kf WHERE kf.episode = s.episode AND kf.frame >= s.start AND kf.frame < s.fin) AS event_hit,
 EXISTS (SELECT 1 FROM st WHERE st.episode = s.episode AND st.frame >= s.start AND st.frame < s.fin) AS stage_hit FROM segs s),
ev AS (SELECT *, 1000.0 * event_hit::INT + 100.0 * stage_hit::INT + motion_score AS score FROM sc)"""


@query(f"WITH {roles.SEGMENTS}, {_EVENTS} SELECT episode, segment::INT AS segment, event_hit, stage_hit, round(score::DOUBLE, 6) AS score FROM ev")
def event_stage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selectors.event_scores(roles.segments(spark, sf_dir), roles.lengths(spark, sf_dir), _keyframes(spark, sf_dir))
    return rows.select("episode", "segment", "event_hit", "stage_hit", F.round("score", 6).alias("score"))


@query(f"WITH {roles.SEGMENTS}, {_EVENTS}, {_greedy_sql('score DESC, episode DESC, segment DESC', 'ev')} SELECT episode, segment::INT AS segment, rank FROM kept")
def event_stage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selectors.select("event_stage", roles.segments(spark, sf_dir), BUDGET, episodes=roles.lengths(spark, sf_dir), keyframes=_keyframes(spark, sf_dir))
    return chosen.select("episode", "segment", "rank")


@query(f"WITH {roles.SEGMENTS}, turns AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY md5('7:' || episode || ':' || segment), segment) AS turn FROM segs), {_greedy_sql('turn, episode', 'turns')} SELECT episode, segment::INT AS segment, rank FROM kept")
def random_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-ordered random selection, round robin over episodes."""
    return selectors.select("random", roles.segments(spark, sf_dir), BUDGET, seed=7).select("episode", "segment", "rank")


@query(f"WITH {roles.SEGMENTS} SELECT episode, segment::INT AS segment, round(motion_score, 4) AS motion_score FROM segs")
def segment_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion summed over segments by running sums."""
    return roles.segments(spark, sf_dir).select("episode", "segment", F.round("motion_score", 4).alias("motion_score"))


@query(f"""WITH {roles.SEGMENTS}, {_greedy_sql('motion_score DESC, episode, segment')}, cov AS (SELECT DISTINCT episode, unnest(generate_series(first, last)) AS action FROM kept),
bins AS (SELECT episode, i AS bin, round_even(i * length / {BINS}.0, 0)::BIGINT AS lo, round_even((i + 1) * length / {BINS}.0, 0)::BIGINT AS hi FROM len, range(0, {BINS}) r(i))
SELECT bin::INT AS bin, sum((SELECT count(*) FROM cov WHERE cov.episode = bins.episode AND action >= lo AND action < hi))::BIGINT AS covered, sum(hi - lo)::BIGINT AS total,
 round(sum((SELECT count(*) FROM cov WHERE cov.episode = bins.episode AND action >= lo AND action < hi)) / greatest(sum(hi - lo), 1), 6) AS coverage_ratio FROM bins GROUP BY bin""")
def coverage_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selectors.select("motion_gripper", roles.segments(spark, sf_dir), BUDGET)
    return selectors.coverage(chosen, roles.lengths(spark, sf_dir), BINS).withColumn("coverage_ratio", F.round("coverage_ratio", 6))


_CHOSEN = "SELECT 'full' AS selector, 1.0::DOUBLE AS budget, * FROM segs UNION ALL SELECT 'motion_gripper', {budget}::DOUBLE, * FROM segs SEMI JOIN kept USING (episode, segment)"


@query(f"""WITH {roles.SEGMENTS}, {_greedy_sql('motion_score DESC, episode, segment')}, c AS ({_CHOSEN.format(budget=BUDGET)}), a AS (SELECT count(DISTINCT (episode, action)) AS n FROM acts),
files AS (SELECT episode, segment, camera, (fin - start) * 100 + camera AS bytes FROM segs, range(0, 2) r(camera) WHERE segment % 5 <> 4 OR camera = 0),
u AS (SELECT selector, count(DISTINCT (episode, x)) AS unique_actions, count(*) AS exposures FROM (SELECT selector, episode, unnest(generate_series(first, last)) AS x FROM c) GROUP BY 1),
o AS (SELECT selector, count(DISTINCT (episode, x)) AS unique_observations FROM (SELECT selector, episode, unnest(generate_series(start, fin)) AS x FROM c) GROUP BY 1),
f AS (SELECT selector, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM c JOIN files USING (episode, segment) GROUP BY 1),
s AS (SELECT selector, budget, count(*) AS segments FROM c GROUP BY ALL)
SELECT selector, budget, segments, unique_actions, unique_observations, exposures, a.n AS all_actions, round(unique_actions / a.n, 6) AS action_ratio, round(exposures / unique_actions, 6) AS overlap_ratio, files, bytes
FROM s JOIN u USING (selector) JOIN o USING (selector) JOIN f USING (selector), a""")
def budget_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a budget keeps: actions, observations, exposures, files and bytes; some segments lack a camera's file."""
    segments = scratch.materialize(roles.segments(spark, sf_dir), "segments")
    cameras = segments.select("episode", "segment", ((F.col("end") - F.col("start")) * 100).alias("b"), F.explode(F.array(F.lit(0), F.lit(1))).alias("camera"))
    files = cameras.filter("segment % 5 <> 4 or camera = 0").select("episode", "segment", "camera", (F.col("b") + F.col("camera")).alias("bytes"))
    rows = selectors.budget_row(segments, segments, "full", 1.0, files).unionByName(
        selectors.budget_row(selectors.select("motion_gripper", segments, BUDGET), segments, "motion_gripper", BUDGET, files))
    return rows.withColumns({c: F.round(c, 6) for c in ("action_ratio", "overlap_ratio")})


@query("""SELECT c_mktsegment AS selector, c_nationkey % 3 AS budget, round(avg(c_acctbal), 6) AS mean, round(coalesce(stddev_samp(c_acctbal), 0.0), 6) AS std, min(c_acctbal) AS least, max(c_acctbal) AS most, count(c_acctbal) AS n FROM customer GROUP BY ALL""")
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("selector"), F.pmod("c_nationkey", F.lit(3)).alias("budget"), "c_acctbal")
    return selectors.seed_aggregate(rows, "c_acctbal", ["selector", "budget"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("""WITH s AS (SELECT p_brand AS selector, (p_size % 4 + 1) * 0.25 AS budget, max(p_retailprice) AS score FROM part GROUP BY ALL), f AS (SELECT selector, max(score) AS full_score FROM s WHERE budget >= 0.999 GROUP BY 1)
SELECT selector, min(budget)::DOUBLE AS budget FROM s JOIN f USING (selector) WHERE score >= 0.99 * full_score GROUP BY 1""")
def sufficient_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the least budget that keeps 99 % of the full score."""
    rows = roles.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("selector"), ((F.pmod("p_size", F.lit(4)) + 1) * 0.25).alias("budget")).agg(F.max("p_retailprice").alias("score"))
    return selectors.sufficient_budget(rows, 0.99)


_RESULTS = """res AS (SELECT c_nationkey AS task, n_regionkey AS class, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS succ_num, count(*)::DOUBLE AS total_num, count(*) FILTER (o_orderstatus = 'F') / count(*) AS succ_rate
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey <> 7 GROUP BY ALL)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (roles.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).filter("c_nationkey <> 7")  # nation has 25 rows
    return joined.groupBy(F.col("c_nationkey").alias("task"), F.col("n_regionkey").alias("class")).agg(
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("succ_num"), F.count(F.lit(1)).cast("double").alias("total_num")
    ).withColumn("succ_rate", F.col("succ_num") / F.col("total_num"))


@query(f"WITH {_RESULTS} SELECT coalesce(class, -1)::INT AS class, round(avg(succ_rate), 6) AS macro_rate, round(sum(succ_num) / sum(total_num), 6) AS micro_rate, count(*) AS tasks, grouping(class)::INT AS is_total FROM res GROUP BY GROUPING SETS ((class), ())")
def success_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.rates(_results(spark, sf_dir), "class")
    return rows.select(F.coalesce("class", F.lit(-1)).alias("class"), F.round("macro_rate", 6).alias("macro_rate"), F.round("micro_rate", 6).alias("micro_rate"), "tasks", "is_total")


@query("WITH s AS (SELECT o_orderkey % 10 AS step, count(*) FILTER (o_orderstatus = 'F') AS succ FROM orders GROUP BY 1) SELECT step, succ FROM s ORDER BY succ DESC, step DESC LIMIT 1")
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "orders").groupBy(F.pmod("o_orderkey", F.lit(10)).alias("step")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("succ"))
    return evaluation.best_checkpoint(rows)


@query(f"""WITH {_RESULTS}, bad AS (SELECT task, succ_num, total_num, CASE WHEN task % 5 = 0 THEN succ_rate + 0.1 ELSE succ_rate END AS succ_rate FROM res)
SELECT n_nationkey AS task, CASE WHEN total_num IS NULL THEN 'missing' WHEN succ_num > total_num OR abs(succ_rate - succ_num / total_num) > 1e-9 THEN 'inconsistent' WHEN total_num < 600 THEN 'partial' ELSE 'complete' END AS status
 FROM nation LEFT JOIN bad ON task = n_nationkey""")
def completeness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing, inconsistent, partial and complete tasks."""
    results = _results(spark, sf_dir).withColumn("succ_rate", F.when(F.col("task") % 5 == 0, F.col("succ_rate") + 0.1).otherwise(F.col("succ_rate")))
    tasks = roles.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"))
    return evaluation.completeness(tasks, results, "task", 600).select("task", "status")


@query("""WITH r AS (SELECT o_orderkey % 4 AS step, o_orderpriority AS task, count(*) FILTER (o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT step, sum(s)::BIGINT AS succ, sum(n)::BIGINT AS total, string_agg(task || '=' || s, ';' ORDER BY task) AS by_task FROM r GROUP BY 1""")
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "orders").groupBy(F.pmod("o_orderkey", F.lit(4)).alias("step"), F.col("o_orderpriority").alias("task")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("succ_num"), F.count(F.lit(1)).alias("total_num"))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries("by_task")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return evaluation.round_summary(rows).select("step", "succ", "total", entries.alias("by_task"))


@query("WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT round(sum(m) / 200.0, 6) AS loss FROM m")
def episode_equal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.equal_episode_mean(roles.table(spark, sf_dir, "events"), "user_id", "value", 200).select(F.round("loss", 6).alias("loss"))


@query("WITH f AS (SELECT l_linenumber, sum(l_quantity * l_discount * (l_tax < 0.05)::INT) / (sum((l_tax < 0.05)::INT) + 1e-6) AS f FROM lineitem GROUP BY 1) SELECT round(avg(f), 6) AS loss FROM f")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "lineitem").withColumn("m", F.col("l_tax") < 0.05)
    return evaluation.masked_mean(rows, "l_linenumber", "l_quantity", "l_discount", "m").select(F.round("loss", 6).alias("loss"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest (a top-k report)."""
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT s_suppkey, ((row_number() OVER (ORDER BY s_suppkey) - 1) % 8)::INT AS shard FROM supplier")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.shard(roles.table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 8)


LIMITS = packing.Limits(ranks=4, per_rank=8, max_tokens=16384, max_items=8)


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As many updates as hold each item that fits once; the last one goes on in the next epoch."""
    items = roles.packing_items(spark, sf_dir).filter(F.col("token_count") <= LIMITS.max_tokens)
    n = items.count()
    occurring = packing.occurrences(items, packing.updates(spark, 0, -(-n // LIMITS.per_update)), LIMITS.per_update, n, 42)
    return packing.plan(occurring, items, LIMITS), items


@query()
def lpt_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest-first ranks and best-fit packs of one epoch; sequential, so without SQL (tested against invariants).

    Items over the token limit are rows without an update.
    """
    over = packing.oversized(roles.packing_items(spark, sf_dir), LIMITS.max_tokens).select("index", "token_count")
    return _plan(spark, sf_dir)[0].unionByName(over, allowMissingColumns=True)


@query()
def packing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, _ = _plan(spark, sf_dir)
    return packing.fill(planned, LIMITS)


@query("""WITH g AS (SELECT label, list(vec_id ORDER BY vec_id) AS ids, list(vec_id % 5 + 1 ORDER BY vec_id) AS lens FROM embeddings GROUP BY 1)
SELECT label, len(ids) AS items, list_sum(lens)::BIGINT AS total, (list_sum(lens) - lens[-1])::BIGINT AS last_offset FROM g""")
def packed_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable-length arrays end to end, with offsets."""
    rows = roles.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.slice("embedding", F.lit(1), (F.pmod("vec_id", F.lit(5)) + 1).cast("int")).alias("v"))
    c = packing.collate(rows, ["label"], "vec_id", "v")
    return c.select("label", F.size("lengths").cast("long").alias("items"), F.size("values").cast("long").alias("total"), F.col("offsets")[F.size("lengths") - 1].cast("long").alias("last_offset"))


@query("SELECT o_orderkey, o_orderkey // 64 AS epoch, o_orderkey % 64 // 8 AS batch_in_epoch, o_orderkey // 8 AS batches_seen, o_orderkey + 1 AS samples_seen FROM orders")
def epoch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in packing.epoch_counters("o_orderkey", 8, 64).items()])
