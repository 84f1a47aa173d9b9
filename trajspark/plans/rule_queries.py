"""Contracts, reports and scalar functions over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, vectors
from ..operators import accounting, contracts, datasets, diff, evaluation, lineage, packing, quality, sequences
from . import roles
from .accounting_queries import _card, _card_sql
from .registry import query
from .selection_queries import LIMITS, _plan, _results, _RESULTS

SEED = 42


@query("SELECT l_returnflag AS dataset, l_linestatus AS task, l_linenumber AS optimizer_step, count(*) AS n FROM lineitem GROUP BY ALL")
def comparable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without the fields that name an attempt, equal ones counted."""
    rows = lineage.comparable(roles.slots(spark, sf_dir), ["training_attempt_id", "resume_generation", "occurrence_id", "rank"])
    return rows.groupBy("dataset", "task", "optimizer_step").agg(F.count(F.lit(1)).alias("n"))


_SUBSET = ["U_seen", "N_eff", "exposure_p50", "mean_replay"]


@query(f"SELECT * FROM ({_card_sql()}) WHERE metric IN ({', '.join(repr(m) for m in _SUBSET)})")
def metric_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.metric_values(_card(spark, sf_dir), _SUBSET)


@query(f"SELECT CASE metric WHEN 'padding_target_slots' THEN 'E_pad' WHEN 'U_eligible' THEN 'support' ELSE metric END AS metric, value, source, unit FROM ({_card_sql()})")
def metric_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card's old metric names under their newer ones."""
    return accounting.rename_metrics(_card(spark, sf_dir), {"padding_target_slots": "E_pad", "U_eligible": "support"}).select("metric", "value", "source", "unit")


@query("SELECT l_linenumber AS optimizer_step, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 3 AND 5 GROUP BY 1")
def step_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.step_range(roles.slots(spark, sf_dir), 3, 5).groupBy("optimizer_step").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.label, q.vec_id AS q_token, k.vec_id % 4 AS k_token FROM embeddings q JOIN (SELECT DISTINCT label FROM embeddings) d ON d.label = q.label JOIN (SELECT DISTINCT label, min(vec_id) OVER (PARTITION BY label, vec_id % 4) AS vec_id FROM embeddings) k ON k.label = q.label WHERE q.label > 0")
def cross_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a token and the prompt tokens of its sequence; sequence -1 sees nothing. A prompt has at most four tokens."""
    e = roles.table(spark, sf_dir, "embeddings").select(F.when(F.col("label") > 0, F.col("label")).otherwise(-1).alias("seq"), F.col("vec_id").alias("token"))
    prompt = e.select("seq", F.pmod("token", F.lit(4)).alias("token")).distinct()
    return sequences.cross_mask_pairs(e, prompt).select(F.col("seq").alias("label"), "q_token", "k_token")


@query("SELECT p_partkey FROM part WHERE p_partkey % 7 NOT IN (0, 3, 5)")
def finite_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("p_partkey", F.lit(7))
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 3, F.lit(float("inf"))).when(k == 5, F.lit(None).cast("double")).otherwise(F.col("p_retailprice"))
    rows = roles.table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), F.col("p_size").cast("double").alias("y"))
    return datasets.finite(rows, ["x", "y"]).select("p_partkey")


@query("""WITH o AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN '/out/again' WHEN s_suppkey % 7 = 0 THEN '/other/x' || s_suppkey WHEN s_suppkey % 11 = 0 THEN '/out/raw/d' || s_suppkey ELSE '/out/d' || s_suppkey END AS path FROM supplier), c AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM o)
SELECT k::VARCHAR AS key, 'repeated' AS rule FROM c WHERE n > 1 UNION ALL SELECT k::VARCHAR, 'no_direct_child' FROM c WHERE regexp_extract(path, '^(.*)/', 1) <> '/out' UNION ALL SELECT k::VARCHAR, 'overlaps_protected' FROM c WHERE path LIKE '/out/raw/%'""")
def output_path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    path = (F.when(k % 10 == 0, "/out/again").when(k % 7 == 0, F.concat(F.lit("/other/x"), text)).when(k % 11 == 0, F.concat(F.lit("/out/raw/d"), text))
            .otherwise(F.concat(F.lit("/out/d"), text)))
    return contracts.output_path_rules(roles.table(spark, sf_dir, "supplier").select(k.alias("name"), path.alias("path")), "/out", ["/out/raw"])


@query("""WITH c AS (SELECT p_partkey, 'p_type' AS field FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT p_partkey, 'p_size' FROM part WHERE p_partkey % 75 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY p_partkey) AS r FROM c)
SELECT field, count(*) AS changed, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) FILTER (r <= 20) AS names FROM r GROUP BY 1""")
def boundary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields (dtype, checksum) that changed over a boundary, with the first names."""
    before = roles.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    after = before.withColumns({"p_type": F.when(F.col("p_partkey") % 50 == 0, "X").otherwise(F.col("p_type")), "p_size": F.when(F.col("p_partkey") % 75 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return contracts.boundary_changes(before, after, "p_partkey", ["p_type", "p_size"])


@query("SELECT l_orderkey, l_linenumber, o_totalprice AS parent_price, l_linestatus <> o_orderstatus AS differs FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def parent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their parents' attributes, and whether the tasks differ."""
    segments = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber", F.col("l_linestatus").alias("task"))
    parents = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("task"))
    joined, _ = datasets.with_parent(segments, parents, "parent")
    return joined.select(F.col("parent").alias("l_orderkey"), "l_linenumber", "parent_price", (F.col("task") != F.col("parent_task")).alias("differs"))


@query("SELECT l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus GROUP BY 1")
def parent_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = roles.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linestatus").alias("task"))
    parents = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.col("o_orderstatus").alias("task"))
    return datasets.with_parent(segments, parents, "parent")[1].groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(o_totalprice) AS price_least, max(o_totalprice) AS price_most, min(o_custkey)::DOUBLE AS customer_least, max(o_custkey)::DOUBLE AS customer_most FROM orders WHERE o_orderkey % 5 <> 0")
def optional_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of text columns, of which every fifth row is absent or no number."""
    k = F.col("o_orderkey") % 10
    text = lambda c: F.when(k == 0, "n/a").when(k == 5, F.lit(None).cast("string")).otherwise(F.col(c).cast("string"))
    return datasets.optional_extremes(roles.table(spark, sf_dir, "orders").select(text("o_totalprice").alias("price"), text("o_custkey").alias("customer")), ["price", "customer"])


@query(f"WITH {_RESULTS}, r AS (SELECT task, CASE WHEN task % 6 <> 0 THEN succ_rate END AS succ_rate FROM res) SELECT task, row_number() OVER (ORDER BY succ_rate DESC NULLS LAST, task) AS place FROM r")
def result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).withColumn("succ_rate", F.when(F.col("task") % 6 != 0, F.col("succ_rate")))
    return evaluation.places(rows).select("task", "place")


@query("""SELECT s_suppkey, sha256('{' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '"nation":' || s_nationkey || ',' END || '"supplier":' || s_suppkey || '}') AS fingerprint,
 CASE WHEN s_suppkey % 5 = 2 THEN 'new' WHEN s_suppkey % 4 = 1 OR s_suppkey % 3 = 0 THEN 'different' ELSE 'same' END AS status FROM supplier""")
def launch_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Launches with an optional field against manifests written before: some are missing, some of another supplier, and all were written with the field."""
    suppliers = roles.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"))
    manifests = suppliers.filter("s_suppkey % 5 <> 2").withColumn("supplier", F.col("supplier") + F.when(F.col("s_suppkey") % 4 == 1, 1).otherwise(0))
    manifests = manifests.select("s_suppkey", F.upper(contracts.identity_digest("nation", "supplier")).alias("identity_sha256"))
    launches = suppliers.withColumn("nation", F.when(F.col("s_suppkey") % 3 != 0, F.col("nation")))
    return contracts.launch_status(launches, manifests, "s_suppkey", ["nation", "supplier"])


@query("WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / (s + 1e-6), 6) AS z, round(l_quantity, 6) AS back FROM lineitem JOIN m ON f = l_returnflag")
def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised values, and their inverse."""
    li = roles.table(spark, sf_dir, "lineitem")
    m = li.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    rows = li.join(m, "l_returnflag").withColumn("z", scalars.standardise("l_quantity", "m", "s"))
    return rows.select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"), F.round(scalars.unstandardise("z", "m", "s"), 6).alias("back"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT i, avg(v) AS mean, greatest(stddev_pop(v), 1e-4) AS std FROM x GROUP BY 1)
SELECT vec_id, round(max(abs((v - mean) / std)), 4) AS greatest, round(sum(((v - mean) / std) ** 2), 3) AS squares FROM x JOIN m USING (i) GROUP BY 1""")
def latent_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors normalised channel by channel with the table's own means and deviations."""
    rows = roles.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    stats = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.greatest(F.stddev_pop("v"), F.lit(1e-4)).alias("std"))
    entries = F.array_sort(F.collect_list(F.struct("i", "mean", (1 / F.col("std")).alias("inverse"))))  # one entry a channel
    arrays = stats.agg(F.transform(entries, lambda e: e["mean"]).alias("mean"), F.transform(entries, lambda e: e["inverse"]).alias("inverse"))
    scaled = rows.crossJoin(F.broadcast(arrays)).select("vec_id", vectors.channel_normalise("x", "mean", "inverse").alias("z"))  # one row on the right
    return scaled.select("vec_id", F.round(F.array_max(F.transform("z", lambda v: F.abs(v))), 4).alias("greatest"), F.round(vectors.dot("z", "z"), 3).alias("squares"))


@query("SELECT o_orderkey, o_orderkey % 2 = 1 AS flag FROM orders")
def strict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "orders").select("o_orderkey", scalars.strict_flag((F.col("o_orderkey") % 2).cast("string")).alias("flag"))


@query("""WITH r AS (SELECT p_size AS g, p_partkey, '{"parameter_name":"' || p_name || '","parameter_shape":"' || p_brand || '","parameter_dtype":"' || p_type || '","step_checksum":"' || p_partkey || '"}' AS j FROM part)
SELECT g, sha256(string_agg(j, chr(10) ORDER BY p_partkey)) AS digest FROM r GROUP BY 1""")
def state_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of parameter states by group, in their order."""
    rows = roles.table(spark, sf_dir, "part").select(
        F.col("p_size").alias("g"), F.col("p_partkey").alias("position_in_group"), F.col("p_name").alias("parameter_name"), F.col("p_brand").alias("parameter_shape"),
        F.col("p_type").alias("parameter_dtype"), F.col("p_partkey").cast("string").alias("step_checksum"))
    return datasets.state_digest(rows, "g")


_FRACTION = 0.1


@query(f"WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:suite:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM d WHERE r <= greatest(1, ceil(n * {_FRACTION}))")
def seeded_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, rounded up, by hash order: a sampling operator."""
    return packing.sample_fraction(roles.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", _FRACTION, 7, "suite")


_STREAM = f"""n AS (SELECT count(*) AS n FROM documents), p AS (SELECT e AS epoch, doc_id AS "index", row_number() OVER (PARTITION BY e ORDER BY md5('{SEED}:' || e || ':' || doc_id), doc_id) - 1 AS place FROM documents, range(0, 3) r(e)),
u AS (SELECT unnest(range(0, ((2 * n + {LIMITS.per_update - 1}) // {LIMITS.per_update}) * {LIMITS.per_update})) AS uid FROM n)"""


@query(f'WITH {_STREAM} SELECT uid // {LIMITS.per_update} AS update_id, uid AS sample_uid, p.epoch, p."index" FROM n, u JOIN p ON p.epoch = uid // (SELECT n FROM n) AND p.place = uid % (SELECT n FROM n)')
def occurrence_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs of all documents, each a permutation, cut into updates without padding."""
    items = roles.packing_items(spark, sf_dir).select("index")
    n = items.count()
    return packing.occurrences(items, packing.updates(spark, 0, -(-2 * n // LIMITS.per_update)), LIMITS.per_update, n, SEED)


_NAIVE = f"""s AS (SELECT doc_id, ceil(n_chars / 128)::BIGINT * 128 AS t, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), w AS (SELECT i // 32 AS update_id, i % 4 AS rank, i // 4 % (1 + (i % 4 = 0)::INT) AS micro, t, lang, i FROM s),
k AS (SELECT update_id, rank, micro, sum(t) AS tokens, count(*) AS n, count(DISTINCT lang) AS shapes FROM w GROUP BY ALL)"""


@query(f"""WITH {_NAIVE} SELECT update_id, 'tokens' AS rule, count(*) AS n FROM k WHERE tokens > {LIMITS.max_tokens} GROUP BY 1 UNION ALL SELECT update_id, 'items', count(*) FROM k WHERE n > {LIMITS.max_items} GROUP BY 1 UNION ALL SELECT update_id, 'shapes', count(*) FROM k WHERE shapes > 1 GROUP BY 1
UNION ALL SELECT update_id, 'micro_counts', 1 FROM (SELECT update_id, rank, count(*) AS m FROM k GROUP BY ALL) GROUP BY 1 HAVING count(DISTINCT m) > 1 UNION ALL SELECT update_id, 'occurrences', 1 FROM w GROUP BY 1 HAVING count(*) <> {LIMITS.per_update}""")
def packing_rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a plan on one that was dealt without them: every kind of violation."""
    from ..operators import order

    items = roles.packing_items(spark, sf_dir)
    rows = order.numbered(items, ["index"], "i").withColumn("i", F.col("i") - 1)
    micro = F.expr("i div 4 % (1 + int(i % 4 = 0))")
    planned = rows.select(F.expr("i div 32").alias("update_id"), (F.col("i") % 4).alias("rank"), micro.alias("micro_idx"), F.col("i").alias("sample_uid"), "index", "token_count")
    return packing.plan_violations(planned, items, LIMITS).groupBy("update_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH i AS (SELECT doc_id, ceil(n_chars / 128)::BIGINT * 128 AS t FROM documents), f AS (SELECT * FROM i WHERE t <= {LIMITS.max_tokens}), n AS (SELECT count(*) AS n FROM f)
SELECT 0::BIGINT AS violations, (SELECT n FROM n) AS items, (SELECT sum(t)::BIGINT FROM f) AS tokens, (SELECT n + ({LIMITS.per_update} - n % {LIMITS.per_update}) % {LIMITS.per_update} FROM n)::BIGINT AS occurrences""")
def packing_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the plan of all items that fit: broken rules, and the first epoch's items and tokens, which are all of them."""
    planned, items = _plan(spark, sf_dir)
    n = items.count()
    first = planned.filter(F.col("sample_uid") < n).agg(F.count_distinct("index").alias("items"), F.sum("token_count").alias("tokens"))
    broken = packing.plan_violations(planned, items, LIMITS).agg(F.count(F.lit(1)).alias("violations"))
    return broken.crossJoin(first).crossJoin(planned.agg(F.count(F.lit(1)).alias("occurrences")))  # one row each


@query(f"""WITH n AS (SELECT count(*) FILTER (ceil(n_chars / 128)::BIGINT * 128 <= {LIMITS.max_tokens}) AS n FROM documents) SELECT unnest(range(0, (n + {LIMITS.per_update - 1}) // {LIMITS.per_update})) AS update_id FROM n EXCEPT
SELECT u FROM (SELECT unnest(range(0, (n + {LIMITS.per_update - 1}) // {LIMITS.per_update})) AS u FROM n) WHERE u % 5 <> 0""")
def replay_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates whose recorded signatures a replay of the planner doesn't give again (every fifth was falsified)."""
    planned, _ = _plan(spark, sf_dir)
    group, fields = ["update_id", "rank", "micro_idx"], ["sample_uid", "index", "token_count"]
    tampered = planned.withColumn("token_count", F.col("token_count") + (F.col("update_id") % 5 == 0).cast("long"))
    replay, _ = _plan(spark, sf_dir)
    found = contracts.recomputed(contracts.signatures(tampered, group, "sample_uid", fields), contracts.signatures(replay, group, "sample_uid", fields), group)
    return found.select("update_id").distinct()


@query("""SELECT sum(octet_length(encode(text)))::BIGINT AS total_lineage_bytes, (SELECT max(l_orderkey)::BIGINT FROM lineitem) AS max_buffered_records, (SELECT max(l_linenumber)::BIGINT FROM lineitem) AS max_pending_records, (SELECT max(l_partkey)::BIGINT FROM lineitem) AS peak_host_rss_bytes,
 (SELECT round(sum(l_tax), 4) FROM lineitem) AS flush_s_rank_sum, round(sum(octet_length(encode(text))) / 400.0, 4) AS bytes_per_sample_occurrence, round(sum(octet_length(encode(text))) * 20000.0 / 10, 4) AS projected_lineage_bytes FROM documents""")
def memory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = roles.table(spark, sf_dir, "documents").select(F.octet_length("text").alias("bytes"))
    summaries = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("max_buffered_records"), F.col("l_linenumber").alias("max_pending_records"), F.col("l_partkey").alias("peak_host_rss_bytes"), F.col("l_tax").alias("flush_s"))
    out = contracts.memory_report(shards, summaries, 400, 10, 20_000)
    return out.withColumns({c: F.round(c, 4) for c in ("flush_s_rank_sum", "bytes_per_sample_occurrence", "projected_lineage_bytes")})


@query("SELECT max(o_totalprice) AS wall_s, max(o_custkey) AS vram FROM orders WHERE o_orderkey % 3 <> 0")
def run_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run figures at their greatest over the summaries of ranks and attempts."""
    known = F.col("o_orderkey") % 3 != 0
    rows = roles.table(spark, sf_dir, "orders").select(F.when(known, F.col("o_totalprice")).alias("wall_s"), F.when(known, F.col("o_custkey")).alias("vram"))
    return contracts.run_maxima(rows, ["wall_s", "vram"])


@query("SELECT round(sum(l_quantity) / count(*), 6) AS mean_action, round(sum(l_tax) / count(*), 6) AS mean_latent, sum(l_linenumber)::BIGINT AS labels, count(*) AS batches FROM lineitem")
def validation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("action"), F.col("l_tax").alias("latent"), F.col("l_linenumber").cast("long").alias("labels"))
    return evaluation.global_batch_means(rows, ["action", "latent"], "labels").withColumns({c: F.round(c, 6) for c in ("mean_action", "mean_latent")})


_CAMERAS = """c AS (SELECT doc_id, source, cam, 1 + n_chars // 100 + (doc_id % 41 = 0 AND cam = 1)::INT AS frames, 48 AS channels, 24 + (doc_id % 37 = 0 AND cam = 2)::INT * 2 AS height, CASE cam WHEN 0 THEN 20 ELSE 10 END AS width FROM documents, range(0, 3) r(cam)),
g AS (SELECT source, doc_id, min(frames) AS f, min(height) AS h, sum(width) AS w, count(DISTINCT frames) AS nf, count(DISTINCT height) AS nh FROM c GROUP BY ALL)"""


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cam"))
    odd = lambda n, cam: ((F.col("doc_id") % n == 0) & (F.col("cam") == cam)).cast("long")
    return d.select("source", "doc_id", (F.expr("1 + n_chars div 100") + odd(41, 1)).alias("frames"), F.lit(48).alias("channels"),
                    (24 + 2 * odd(37, 2)).alias("height"), F.when(F.col("cam") == 0, 20).otherwise(10).cast("long").alias("width"), F.lit(4).alias("step"))


@query(f"""WITH {_CAMERAS} SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS "index", concat_ws('|', source, doc_id) AS sample_key, f AS frame_count, ((2 * (f * (h // 2) * (w // 2) + f * 16) + 127) // 128 * 128)::BIGINT AS token_count, '48x' || h || 'x' || w || 'x30x16x1' AS shape_signature FROM g WHERE nf = 1 AND nh = 1""")
def packing_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to pack, made from their cameras' records; samples whose cameras disagree are not in it."""
    return contracts.packing_metadata(_cameras(spark, sf_dir), ["source", "doc_id"], 16, (2, 2), 30)[0]


@query(f"WITH {_CAMERAS} SELECT concat_ws('|', source, doc_id) AS key, 'differing_frames' AS rule FROM g WHERE nf > 1 UNION ALL SELECT concat_ws('|', source, doc_id), 'differing_height' FROM g WHERE nh > 1")
def packing_manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.packing_metadata(_cameras(spark, sf_dir), ["source", "doc_id"], 16, (2, 2), 30)[1]


@query("""WITH u AS (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS update_id), d AS (SELECT update_id, md5('42:' || update_id || ':layout') AS h FROM u)
SELECT update_id, r::INT AS rank, 1 + ('0x' || substr(h, 1, 8))::BIGINT % 4 AS chunk, 4 + ('0x' || substr(h, 9, 8))::BIGINT % 61 AS "window" FROM d, range(0, 4) x(r)""")
def shared_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random layout an update, the same on all ranks."""
    return packing.shared_layout(packing.updates(spark, 0, roles.table(spark, sf_dir, "documents").count()), 4, SEED)


@query("""WITH v AS (SELECT a * 30 + b * 5 + c AS place, (a + 2) * 3 AS f, b AS h, c AS w FROM range(0, 7) x(a), range(0, 6) y(b), range(0, 5) z(c))
SELECT 'visual' AS kind, place, f::DOUBLE AS f, h::DOUBLE AS h, w::DOUBLE AS w, 4.0::DOUBLE AS t FROM v UNION ALL SELECT 'action', place, round((f + (h + 1) / 7.0)::DOUBLE, 9), -1.0, -1.0, 5.0 FROM v""")
def mesh_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a grid of frames, heights and widths, and of the action rows between frames."""
    visual, action = (contracts.mesh_ids(spark, 7, 6, 5, t, 3, 2, a).select(F.lit(k).alias("kind"), "place", F.round("f", 9).alias("f"), "h", "w", "t") for k, t, a in (("visual", 4, False), ("action", 5, True)))
    return visual.unionByName(action)


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id, e[1:4] AS a, e[5:8] AS b FROM q), m AS (SELECT vec_id, [a[1]*b[1]-a[2]*b[2]-a[3]*b[3]-a[4]*b[4], a[1]*b[2]+a[2]*b[1]+a[3]*b[4]-a[4]*b[3], a[1]*b[3]-a[2]*b[4]+a[3]*b[1]+a[4]*b[2], a[1]*b[4]+a[2]*b[3]-a[3]*b[2]+a[4]*b[1]] AS r, a[2] + b[2] AS x FROM p)
SELECT vec_id, round(r[1] / sqrt(list_sum([v * v for v in r])), 5) AS w, round(r[4] / sqrt(list_sum([v * v for v in r])), 5) AS z, round(x, 5) AS x FROM m""")
def pose_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations added and rotations multiplied."""
    e = roles.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = e.select("vec_id", F.slice("e", 1, 4).alias("a"), F.slice("e", 5, 4).alias("b"), F.slice("e", 2, 3).alias("u"), F.slice("e", 6, 3).alias("v"))
    moved, turned = vectors.compose_pose("u", "a", "v", "b")
    rows = rows.select("vec_id", moved.alias("m"), turned.alias("q"))
    return rows.select("vec_id", F.round(F.col("q")[0], 5).alias("w"), F.round(F.col("q")[3], 5).alias("z"), F.round(F.col("m")[0], 5).alias("x"))


@query("SELECT source || ': ' || doc_id AS key, 'too_short' AS rule FROM documents WHERE n_chars < 100")
def collection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each subset's report with the subset's name in front."""
    d = roles.table(spark, sf_dir, "documents")
    found = quality.violations(d.withColumn("k", F.concat_ws("\t", "source", "doc_id")), "k", {"too_short": F.col("n_chars") < 100})
    reports = found.select(F.split("key", "\t")[0].alias("subset"), F.split("key", "\t")[1].alias("key"), "rule")
    return datasets.collection_audit(reports)


@query("""WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 2 ELSE 3 END AS version, CASE WHEN s_suppkey % 4 = 0 THEN [1, 2] ELSE [1, 2, 2] END AS patch, CASE WHEN s_suppkey % 9 <> 0 THEN -1.5 END AS low FROM supplier)
SELECT s_suppkey::VARCHAR AS key, 'differing_version' AS rule FROM r WHERE version <> 3 UNION ALL SELECT s_suppkey::VARCHAR, 'differing_patch_size' FROM r WHERE patch <> [1, 2, 2] UNION ALL SELECT s_suppkey::VARCHAR, 'differing_clip_low' FROM r WHERE low IS NULL""")
def contract_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts against their contract: scalars, lists and nested fields; a missing one differs."""
    k, ints = F.col("s_suppkey"), lambda *v: F.array(*map(F.lit, v))
    rows = roles.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(k % 6 == 0, 2).otherwise(3).alias("version"), F.when(k % 4 == 0, ints(1, 2)).otherwise(ints(1, 2, 2)).alias("patch_size"), F.struct(F.when(k % 9 != 0, -1.5).alias("low")).alias("clip"))
    return contracts.field_rules(rows, "s_suppkey", {"version": 3, "patch_size": ints(1, 2, 2), "clip.low": -1.5})


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'rear' ELSE 'left' END AS camera, CASE WHEN doc_id % 47 = 0 THEN 'a/../b' WHEN doc_id % 53 = 0 THEN 'same.pth' ELSE 'latent-' || doc_id END AS path, CASE WHEN doc_id % 29 = 0 THEN 'xyz' ELSE sha256(source) END AS sha, n_chars - 60 AS size, doc_id % 13 AS frames, doc_id - (doc_id % 61 = 1)::INT AS ep FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY ep, camera) AS k, count(*) OVER (PARTITION BY path) AS p FROM e)
SELECT path AS key, 'unknown_camera' AS rule FROM c WHERE camera = 'rear' UNION ALL SELECT path, 'unsafe_path' FROM c WHERE path = 'a/../b' UNION ALL SELECT path, 'bad_digest' FROM c WHERE sha = 'xyz' UNION ALL SELECT path, 'empty_file' FROM c WHERE size <= 0
UNION ALL SELECT path, 'no_frames' FROM c WHERE frames <= 0 UNION ALL SELECT path, 'repeated_key' FROM c WHERE k > 1 UNION ALL SELECT path, 'repeated_path' FROM c WHERE p > 1""")
def latent_manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = roles.table(spark, sf_dir, "documents").select(
        (k - (k % 61 == 1).cast("long")).alias("episode_index"), F.when(k % 31 == 0, "rear").otherwise("left").alias("camera_key"),
        F.when(k % 47 == 0, "a/../b").when(k % 53 == 0, "same.pth").otherwise(F.concat(F.lit("latent-"), k.cast("string"))).alias("path"),
        (F.col("n_chars") - 60).alias("size"), (k % 13).alias("frames"), F.when(k % 29 == 0, "xyz").otherwise(F.sha2(F.col("source").cast("binary"), 256)).alias("sha256"))
    return contracts.entry_rules(rows, ["left", "right", "top"])


@query("""WITH s AS (SELECT s_suppkey AS k, 17 + s_suppkey % 50 AS raw FROM supplier), r AS (SELECT *, greatest((raw - 1) // 16 * 16, 0) AS n FROM s)
SELECT k::VARCHAR AS key, rule FROM (SELECT k, 'action_shape' AS rule FROM r WHERE k % 8 = 0 UNION ALL SELECT k, 'mask_open' FROM r WHERE k % 9 = 0 UNION ALL SELECT k, 'source_digest' FROM r WHERE k % 10 = 0 UNION ALL SELECT k, 'action_not_finite' FROM r WHERE k % 11 = 0
 UNION ALL SELECT k, 'tail_discarded_count' FROM r WHERE k % 12 = 0 UNION ALL SELECT k, 'prefix_not_zero' FROM r WHERE k % 14 = 0)""")
def sidecar_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action sidecars with planted faults; the others can be reused."""
    k, n = F.col("s_suppkey"), F.greatest(contracts.real_actions("raw_length"), F.lit(0))
    rows = roles.table(spark, sf_dir, "supplier").select("s_suppkey", (17 + k % 50).cast("long").alias("raw_length"), F.sha2(F.col("s_suppkey").cast("string").cast("binary"), 256).alias("raw_sha256"))
    row = lambda fill, last: F.concat(F.array_repeat(fill, contracts.ACTION_WIDTH - 1), F.array(last))
    real = row(F.when(k % 11 == 0, F.lit(float("inf"))).otherwise(F.lit(0.5)), F.lit(0.0))
    prefix = row(F.when(k % 14 == 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(0.0))
    action = F.concat(F.array_repeat(prefix, contracts.ZERO_PREFIX), F.transform(scalars.interval_ids(n + (k % 8 == 0).cast("long")), lambda _: real))
    mask = F.transform(scalars.interval_ids(n + contracts.ZERO_PREFIX), lambda _: F.array_repeat(k % 9 != 0, contracts.ACTION_WIDTH))
    rows = rows.select("*", action.alias("action"), mask.alias("mask"), F.array_repeat(F.lit(0.1), contracts.ANCHOR_WIDTH).alias("anchor"), F.col("raw_length").alias("source_length"), n.alias("real_action_count"),
                       F.lit(contracts.ZERO_PREFIX).alias("zero_prefix_count"), (F.col("raw_length") - n + (k % 12 == 0).cast("long")).alias("tail_discarded_count"),
                       F.when(k % 10 == 0, "old").otherwise(F.col("raw_sha256")).alias("source_sha256"),
                       F.concat(F.array_repeat(F.lit(-1).cast("long"), contracts.ZERO_PREFIX), scalars.interval_ids(n)).alias("source_frame_ids"))
    return contracts.sidecar_rules(rows, "s_suppkey")


@query("""WITH l AS (SELECT c_mktsegment AS segment, CASE WHEN c_nationkey % 7 = 0 AND c_mktsegment LIKE 'A%' THEN c_nationkey + 100 ELSE c_nationkey END AS k FROM customer), g AS (SELECT DISTINCT c_mktsegment AS segment FROM customer),
w AS (SELECT segment, n_nationkey AS k FROM g, nation), m AS (SELECT * FROM w EXCEPT SELECT * FROM l), x AS (SELECT * FROM l EXCEPT SELECT * FROM w)
SELECT (SELECT count(*) FROM m) = 0 AND (SELECT count(*) FROM x) = 0 AS same, (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM x) AS extra""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every segment's customers come from all nations and no others; one segment has strange ones in the place of some."""
    customers, nation = roles.table(spark, sf_dir, "customer"), roles.table(spark, sf_dir, "nation")
    strange = (F.pmod("c_nationkey", F.lit(7)) == 0) & F.startswith(F.col("c_mktsegment"), F.lit("A"))
    actual = customers.select(F.col("c_mktsegment").alias("segment"), F.when(strange, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("k"))
    wanted = quality.expected_keys(customers.select(F.col("c_mktsegment").alias("segment")), nation.select(F.col("n_nationkey").alias("k")))  # 25 nations
    return diff.set_equality(wanted, actual, ["segment", "k"])


@query(f"""WITH {_RESULTS}, p AS (SELECT *, CASE WHEN task % 11 = 4 THEN 'v2' ELSE 'v1' END AS version FROM res WHERE task % 9 <> 2), e AS (SELECT n_nationkey AS task, n_regionkey AS class FROM nation),
f AS (SELECT e.task, 'missing' AS fault FROM e WHERE task NOT IN (SELECT task FROM p) UNION SELECT task, 'partial' FROM p WHERE total_num < 20 UNION SELECT task, 'protocol' FROM p WHERE version <> 'v1'),
n AS (SELECT task, count(*) AS n FROM f GROUP BY 1)
SELECT e.class, sum(succ_num) AS succ, sum(total_num) AS total, CASE WHEN coalesce(sum(n), 0) = 0 THEN round(sum(succ_num) / sum(total_num), 6) END AS pooled_rate, coalesce(sum(n), 0)::BIGINT AS faults
FROM e LEFT JOIN p USING (task) LEFT JOIN n USING (task) GROUP BY 1""")
def pooled_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled success by class; missing, partial and other protocols' results leave their class without a rate."""
    results = _results(spark, sf_dir).filter("task % 9 <> 2").drop("class").withColumn("version", F.when(F.pmod("task", F.lit(11)) == 4, "v2").otherwise("v1"))
    tasks = roles.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), F.col("n_regionkey").alias("class"))
    return evaluation.pooled_success(tasks, results, "task", "class", 20, {"version": "v1"}).withColumn("pooled_rate", F.round("pooled_rate", 6))


@query(f"""WITH {_RESULTS} SELECT n_nationkey AS task, CASE WHEN total_num IS NULL THEN 'fresh' WHEN n_nationkey % 4 = 1 THEN 'mismatch' ELSE 'resumed' END AS status,
 CASE WHEN total_num IS NULL OR n_nationkey % 4 = 1 THEN 0 ELSE succ_num END AS succ_num, CASE WHEN total_num IS NULL OR n_nationkey % 4 = 1 THEN 0 ELSE total_num END AS total_num FROM nation LEFT JOIN res ON task = n_nationkey""")
def resumed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of an evaluation that goes on: those made with another seed or step count are refused."""
    results = _results(spark, sf_dir).withColumns({"seed": F.when(F.col("task") % 4 == 1, 8).otherwise(7), "steps": F.lit(50)})
    now = roles.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task"), F.lit(7).alias("seed"), F.lit(50).alias("steps"))
    return evaluation.resumable(now, results, "task", ["seed", "steps"])
