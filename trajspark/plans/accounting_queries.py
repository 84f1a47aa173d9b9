"""Exposure accounting over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import accounting, diff, evaluation, lineage, order
from . import roles
from .registry import query

WALL, WORLD, VRAM = 1000.0, 2, 1234


def _card_sql(group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    on = f" USING ({group})" if group else " ON true"
    metrics = [
        ("sample_draws", "draws", "exact", "sample occurrences"), ("optimizer_steps", "steps", "exact", "optimizer updates"),
        ("U_eligible", "NULL", "analytical", "canonical action targets"), ("U_seen", "u", "exact", "canonical action targets"),
        ("E_action_unweighted", "eu", "exact", "target exposures"), ("E_action_weighted", "ew", "exact", "loss-weighted target exposures"),
        ("mean_replay", "ew / u", "exact", "weighted exposures per seen target"), ("mean_replay_unweighted", "eu / u", "exact", "unweighted exposures per seen target"),
        ("exposure_p10", "q[1]", "exact", "weighted exposures"), ("exposure_p50", "q[2]", "exact", "weighted exposures"),
        ("exposure_p90", "q[3]", "exact", "weighted exposures"), ("exposure_p99", "q[4]", "exact", "weighted exposures"),
        ("N_eff", "n_eff", "exact", "canonical action targets"), ("N_eff/U_seen", "n_eff / u", "exact", ""),
        ("zero_exposure_fraction_eligible", "NULL", "exact", ""), ("padding_target_slots", "pad", "exact", "target slots"),
        ("invalid_or_zero_weight_slots", "inv", "exact", "target slots"), ("training_wall_clock", f"{WALL}", "exact", "seconds"),
        ("training_GPU_hours", f"{WALL} * {WORLD} / 3600.0", "analytical", "GPU-hours"), ("valid_targets_per_second", f"eu / {WALL}", "exact", "unweighted valid real targets/s"),
        ("peak_VRAM", f"{VRAM}", "exact", "bytes"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT {g}'{m}' AS metric, round(({v})::DOUBLE, 6) AS value, CASE WHEN ({v}) IS NULL THEN 'unavailable' ELSE '{s}' END AS source, '{u}' AS unit FROM wide" for m, v, s, u in metrics
    )
    return f"""WITH {roles.RECORDS},
d AS (SELECT {g}count(*) AS draws, count(DISTINCT l_linenumber) AS steps FROM records WHERE done{by}),
e AS (SELECT {g}count(*) AS u, sum(eu) AS eu, sum(ew) AS ew, sum(ew) ** 2 / sum(ew * ew) AS n_eff, quantile_cont(ew, [0.1, 0.5, 0.9, 0.99]) AS q FROM seen{by}),
p AS (SELECT {g}count(*) FILTER (target_t < 0) AS pad, count(*) FILTER (target_t >= 0 AND NOT (valid AND weight > 0)) AS inv FROM slots WHERE done{by}),
wide AS (SELECT * FROM d JOIN e{on} JOIN p{on})
{rows}"""


def _card(spark: SparkSession, sf_dir: str, group: list[str] | None = None) -> DataFrame:
    records = roles.records(spark, sf_dir)
    slots = lineage.explode_targets(records)
    card = accounting.resource_card(records, slots, group=group, wall_clock_s=WALL, world_size=WORLD, peak_vram=VRAM)
    return card.withColumns({"value": F.round("value", 6), "unit": F.coalesce("unit", F.lit(""))})


@query(_card_sql())
def resource_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: nested records to the long card of the whole run."""
    return _card(spark, sf_dir)


@query(_card_sql("dataset"))
def resource_card_by_source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards counted for each group alone."""
    return _card(spark, sf_dir, ["dataset"])


@query(f"WITH {roles.SLOTS} SELECT dataset, task, episode, target_t, round(ew, 6) AS exposure_weighted, eu AS exposure_unweighted, first_step, last_step FROM seen")
def exposure_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.exposures(roles.slots(spark, sf_dir)).withColumn("exposure_weighted", F.round("exposure_weighted", 6))


@query(f"""WITH {roles.SLOTS}, s AS (SELECT dataset, task, episode, target_t, count(DISTINCT rank) AS rank_count, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS source_views,
 string_agg(DISTINCT task, ',' ORDER BY task) AS phases, string_agg(DISTINCT 'm' || (occurrence % 3), ',' ORDER BY 'm' || (occurrence % 3)) AS subset_manifest_ids, count(*) AS exposure_unweighted FROM hits GROUP BY ALL) SELECT * FROM s""")
def exposure_with_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures of each target with the views, phases and subset manifests that they came from."""
    slots = roles.slots(spark, sf_dir).withColumn("subset_manifest_id", F.concat(F.lit("m"), F.pmod("occurrence_id", F.lit(3)).cast("string")))
    rows = lineage.exposures_with_sets(slots, ("source_view", "phase", "subset_manifest_id"))
    lists = [F.array_join(c, ",").alias(c) for c in ("source_views", "phases", "subset_manifest_ids")]
    return rows.select(*lineage.TARGET, "rank_count", *lists, "exposure_unweighted")


@query(f"""WITH {roles.ELIGIBLE} SELECT e.episode, e.target_t, s.eu IS NOT NULL AS seen, coalesce(s.eu, 0) AS exposure_unweighted, round(coalesce(s.ew, 0.0), 6) AS exposure_weighted
 FROM eligible e LEFT JOIN seen s USING (episode, target_t)""")
def label_exposure_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage.label_exposure(roles.eligible(spark, sf_dir), roles.seen_of_eligible(spark, sf_dir), ["episode", "target_t"])
    return rows.select("episode", "target_t", "seen", "exposure_unweighted", F.round("exposure_weighted", 6).alias("exposure_weighted"))


@query(f"""WITH {roles.ELIGIBLE} SELECT round(avg(CASE WHEN s.eu IS NULL THEN 1.0 ELSE 0.0 END), 6) AS zero_fraction, count(*) AS u_eligible, count(s.eu) AS seen_and_eligible
 FROM eligible e LEFT JOIN seen s USING (episode, target_t)""")
def zero_exposure_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    support, seen = roles.eligible(spark, sf_dir).select("episode", "target_t"), roles.seen_of_eligible(spark, sf_dir)
    n = support.agg(F.count(F.lit(1)).alias("u_eligible"))
    both = support.join(seen, ["episode", "target_t"], "left_semi").agg(F.count(F.lit(1)).alias("seen_and_eligible"))
    return accounting.zero_fraction(support, seen, ["episode", "target_t"]).select(F.round("zero_fraction", 6).alias("zero_fraction")).crossJoin(n).crossJoin(both)  # one row each


@query(f"""WITH {roles.ELIGIBLE}, l AS (SELECT s.eu IS NOT NULL AS seen, coalesce(s.eu, 0) AS x FROM eligible e LEFT JOIN seen s USING (episode, target_t)),
q AS (SELECT 'seen' AS support, quantile_cont(x, [0.1, 0.5, 0.9, 0.99]) AS q FROM l WHERE seen UNION ALL SELECT 'eligible', quantile_cont(x, [0.1, 0.5, 0.9, 0.99]) FROM l)
SELECT support, round(q[1], 6) AS p10, round(q[2], 6) AS p50, round(q[3], 6) AS p90, round(q[4], 6) AS p99 FROM q""")
def exposure_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over seen targets, and over all eligible ones with their zeros."""
    rows = lineage.label_exposure(roles.eligible(spark, sf_dir), roles.seen_of_eligible(spark, sf_dir), ["episode", "target_t"])

    def of(name: str, part: DataFrame) -> DataFrame:
        found = order.quantiles(part, "exposure_unweighted", accounting.QUANTILES, 0.0)
        return found.select(F.lit(name).alias("support"), *[F.round(k, 6).alias(k) for k in accounting.QUANTILES])

    return of("seen", rows.filter("seen")).unionByName(of("eligible", rows))


@query(f"WITH {roles.SLOTS} SELECT dataset, round(sum(eu) ** 2 / sum(eu * eu), 6) AS n_eff, round(sum(ew) ** 2 / sum(ew * ew), 6) AS n_eff_weighted FROM seen GROUP BY 1")
def effective_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.exposures(roles.slots(spark, sf_dir)).groupBy("dataset").agg(
        F.round(accounting.effective_support(F.col("exposure_unweighted").cast("double")), 6).alias("n_eff"), F.round(accounting.effective_support("exposure_weighted"), 6).alias("n_eff_weighted")
    )


@query(f"WITH {roles.SLOTS} SELECT eu AS exposure, count(*) AS targets FROM seen GROUP BY 1")
def exposure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.exposures(roles.slots(spark, sf_dir)).groupBy(F.col("exposure_unweighted").alias("exposure")).agg(F.count(F.lit(1)).alias("targets"))


@query(f"""WITH {roles.SLOTS}, t AS (SELECT dataset, count(*) FILTER (target_t < 0) AS padding_slots, count(*) FILTER (target_t >= 0 AND NOT (valid AND weight > 0 AND done)) AS invalid_slots,
 count(*) FILTER (target_t >= 0 AND valid AND weight > 0 AND done) AS effective_slots, sum(weight) FILTER (target_t < 0) AS pm, sum(weight) FILTER (target_t >= 0 AND valid AND weight > 0 AND done) AS am FROM slots GROUP BY 1)
SELECT dataset, padding_slots, invalid_slots, effective_slots, round(pm, 6) AS padding_mass, round(pm / (pm + am), 6) AS padding_fraction FROM t""")
def padding_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding on all rows, uncommitted real slots as invalid, and the padding's share of the mass."""
    rows = lineage.slot_totals_all_rows(roles.slots(spark, sf_dir), "dataset")
    share = F.try_divide(F.col("padding_mass"), F.col("padding_mass") + F.col("action_mass"))
    return rows.select("dataset", "padding_slots", "invalid_slots", "effective_slots", F.round("padding_mass", 6).alias("padding_mass"), F.round(share, 6).alias("padding_fraction"))


@query(f"WITH {roles.SLOTS} SELECT task, count(*) FILTER (target_t < 0) AS padding_slots, count(*) FILTER (target_t >= 0 AND NOT (valid AND weight > 0)) AS invalid_slots, count(*) FILTER (target_t >= 0 AND valid AND weight > 0) AS effective_slots FROM slots WHERE done GROUP BY 1")
def slot_kinds_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.slot_totals(roles.slots(spark, sf_dir), "task")


@query(f"WITH {roles.SLOTS} SELECT occurrence AS occurrence_id, generation AS resume_generation, episode, target_t, round(weight, 6) AS weight FROM (SELECT *, max(generation) OVER (PARTITION BY occurrence) AS g FROM slots) WHERE generation = g")
def max_generation_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the greatest generation survive, repeats at it included."""
    return lineage.accept_latest(roles.slots(spark, sf_dir)).select("occurrence_id", "resume_generation", "episode", "target_t", F.round("weight", 6).alias("weight"))


@query(f"WITH {roles.SLOTS} SELECT occurrence AS occurrence_id, count(*) AS n FROM slots GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, 1 LIMIT 20")
def duplicate_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most repeated occurrences (a top-k report)."""
    return lineage.duplicate_occurrences(roles.slots(spark, sf_dir)).orderBy(F.desc("n"), "occurrence_id").limit(20)


@query(f"WITH {roles.SLOTS} SELECT optimizer_step, string_agg(DISTINCT attempt::VARCHAR, ',' ORDER BY attempt::VARCHAR) AS attempts FROM slots GROUP BY 1")
def attempt_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.attempts_by_step(roles.slots(spark, sf_dir)).select("optimizer_step", F.array_join("attempts", ",").alias("attempts"))


@query(f"WITH {roles.SLOTS}, i AS (SELECT dataset, concat_ws(chr(9), dataset, task, episode, target_t) AS id FROM seen) SELECT dataset, sha256(string_agg(id, chr(10) ORDER BY id) || chr(10)) AS support_sha256, count(*) AS ids FROM i GROUP BY 1")
def support_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage.exposures(roles.slots(spark, sf_dir)).select("dataset", scalars.canonical_id(*lineage.TARGET).alias("id"))
    return rows.groupBy("dataset").agg(scalars.support_digest(F.col("id")).alias("support_sha256"), F.count_distinct("id").alias("ids"))


@query(f"WITH {roles.SLOTS} SELECT concat_ws(chr(9), dataset, task, episode, target_t) AS canonical_id, eu AS n FROM seen")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.exposures(roles.slots(spark, sf_dir)).select(scalars.canonical_id(*lineage.TARGET).alias("canonical_id"), F.col("exposure_unweighted").alias("n"))


@query("""SELECT o_orderkey, sha256('{"logical_run_id":"run-' || o_orderstatus || '","microbatch_id":' || o_custkey % 8 || ',"optimizer_step":' || o_orderkey // 32 || ',"rank":' || o_orderkey % 4 || ',"sample_slot":' || o_orderkey % 16 || '}') AS occurrence_id FROM orders""")
def occurrence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.floor(F.col("o_orderkey") / F.lit(32)).cast("long")
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", scalars.occurrence_id(
        F.concat(F.lit("run-"), "o_orderstatus"), F.pmod("o_orderkey", F.lit(4)), step, F.pmod("o_custkey", F.lit(8)), F.pmod("o_orderkey", F.lit(16))
    ).alias("occurrence_id"))


@query("WITH r AS (SELECT user_id % 8 AS rank, sum(value) AS s FROM events GROUP BY 1) SELECT round(max(s), 6) AS rank_max, round(avg(s), 6) AS rank_mean, round(sum(s), 6) AS rank_sum, count(*) AS n_ranks FROM r")
def timing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(8)).alias("rank"), "value")
    return evaluation.timing(rows, "rank", "value").select(*[F.round(c, 6).alias(c) for c in ("rank_max", "rank_mean", "rank_sum")], F.size("ranks").cast("long").alias("n_ranks"))


@query("""SELECT coalesce(c_mktsegment, 'total') AS suite, sum(c_nationkey + 1)::BIGINT AS c_unique, sum(c_custkey % 100)::BIGINT AS c_seen, round(sum(c_custkey % 100) / sum(c_nationkey + 1), 6) AS replay,
 sum(c_custkey % 7)::BIGINT AS hours, min(c_custkey % 100) AS least_seen, max(c_custkey % 100) AS most_seen FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def ledger_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("suite"), (F.col("c_nationkey") + 1).cast("long").alias("u"), F.pmod("c_custkey", F.lit(100)).alias("s"), F.pmod("c_custkey", F.lit(7)).alias("h"))
    return evaluation.ledger(rows, "u", "s", "h", "suite").withColumns({"suite": F.coalesce("suite", F.lit("total")), "replay": F.round("replay", 6)})


@query("WITH p AS (SELECT l_returnflag AS part, l_linestatus AS g, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag AS part, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1")
def moments_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of parts (by line status), merged into their wholes."""
    rows = roles.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("part"), "l_linestatus", "l_quantity")
    merged = accounting.merge_moments(accounting.moments(rows, "l_quantity", "part", "l_linestatus"), "part")
    return merged.select("part", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {roles.SLOTS} SELECT dataset, round(-sum((eu / t) * ln(eu / t)), 6) AS entropy FROM (SELECT *, sum(eu) OVER (PARTITION BY dataset) AS t FROM seen) GROUP BY 1")
def replay_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: entropy of the exposures' shares."""
    return lineage.exposures(roles.slots(spark, sf_dir)).groupBy("dataset").agg(F.round(accounting.replay_entropy(F.col("exposure_unweighted").cast("double")), 6).alias("entropy"))


@query("""WITH r AS (SELECT o_orderpriority AS task, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1), p AS (SELECT *, s / n AS p, 1.959963984540054 AS z FROM r)
SELECT task, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: score intervals of success rates."""
    rows = roles.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg(F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = accounting.wilson_interval(F.col("s"), F.col("n"))
    return rows.select("task", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH a AS (SELECT 'rows' AS name, count(*)::DOUBLE AS actual FROM lineitem UNION ALL SELECT 'orders', count(DISTINCT l_orderkey)::DOUBLE FROM lineitem) SELECT name, actual, CASE name WHEN 'rows' THEN actual ELSE -1.0 END AS expected, name = 'rows' AS passed FROM a""")
def assertion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named checks with tolerant equality; one passes, one fails."""
    li = roles.table(spark, sf_dir, "lineitem")
    rows = li.agg(F.count(F.lit(1)).cast("double").alias("a"), F.count_distinct("l_orderkey").cast("double").alias("b"))
    checks = rows.select(F.explode(F.array(
        F.struct(F.lit("rows").alias("name"), F.col("a").alias("expected"), F.col("a").alias("actual")), F.struct(F.lit("orders").alias("name"), F.lit(-1.0).alias("expected"), F.col("b").alias("actual")),
    )).alias("c")).select("c.*")
    return diff.assertions(checks)
