"""Sequence operators, normalisation, geometry and log scans over the stock tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import scalars, vectors
from ..operators import lineage, sequences
from ..sources import readers
from . import roles
from .registry import query

USER, STEP = ["user_id"], ["t"]


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(f"WITH {roles.MOTION} SELECT user_id, event_id, t, round(motion, 6) AS motion FROM motion")
def motion_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.motion(spark, sf_dir).select("user_id", "event_id", "t", _r("motion"))


@query(f"WITH {roles.SERIES} SELECT user_id, t, round(sum(value) OVER (PARTITION BY user_id ORDER BY t), 4) AS total, round(value - first_value(value) OVER (PARTITION BY user_id ORDER BY t), 6) AS local FROM series")
def inclusive_cumsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums, and anchors at the first row."""
    rows = sequences.cumulated(roles.series(spark, sf_dir), "value", USER, STEP, "total")
    return sequences.anchored(rows, "value", USER, STEP, "local").select("user_id", "t", _r("total", 4), _r("local"))


@query(f"""WITH {roles.SERIES}, c AS (SELECT *, t // 16 AS segment, sum(value) OVER (PARTITION BY user_id ORDER BY t) AS cum FROM series),
b AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY user_id ORDER BY t), 0.0) AS before FROM c)
SELECT user_id, t, segment, round(value - first_value(value) OVER w, 6) AS value_local, round(cum - first_value(before) OVER w, 4) AS cum_local FROM b WINDOW w AS (PARTITION BY user_id, segment ORDER BY t)""")
def reanchor_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences.cumulated(roles.series(spark, sf_dir), "value", USER, STEP, "cum").withColumn("segment", F.floor(F.col("t") / F.lit(16)).cast("long"))
    return sequences.reanchored(rows, "value", "cum", USER, "segment", STEP).select("user_id", "t", "segment", _r("value_local"), _r("cum_local", 4))


@query(f"WITH {roles.SERIES}, l AS (SELECT user_id, t, value, lead(value, 16) OVER (PARTITION BY user_id ORDER BY t) AS target, t / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) AS p FROM series) SELECT user_id, t, value, target, round(p, 6) AS progress FROM l WHERE target IS NOT NULL")
def lead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supervised pairs 16 steps apart, with normalised progress."""
    rows = sequences.progress(roles.series(spark, sf_dir), USER)
    return sequences.lead_pairs(rows, "value", 16, USER, STEP, "target").select("user_id", "t", "value", "target", _r("progress"))


@query(f"""WITH {roles.SERIES}, n AS (SELECT *, 16 * ((count(*) OVER (PARTITION BY user_id) - 1) // 16) AS k FROM series)
SELECT user_id, t, value FROM n WHERE t < k UNION ALL SELECT user_id, unnest(generate_series(-16, -1)), 0.0 FROM (SELECT DISTINCT user_id FROM events)""")
def zero_prefix_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.pad_and_trim(roles.series(spark, sf_dir), USER, "t", "value")


@query("""WITH d AS (SELECT doc_id, n_chars % 97 + 1 AS n FROM documents), w AS (SELECT doc_id, (n - 1) // 4 * 16 AS want, least((n - 1) // 4 * 16, n) AS have FROM d)
SELECT doc_id, 16 + want - have AS padding, have AS real, 16 + want AS slots, CASE WHEN have > 0 THEN have - 1 ELSE -1 END AS last_target FROM w""")
def target_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding prefix, real targets and padding tail of frame sequences."""
    n = F.pmod("n_chars", F.lit(97)) + 1
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", lineage.target_times(n, real=n).alias("t"))
    real = F.size(F.filter("t", lambda x: x >= 0)).cast("long")
    return rows.select("doc_id", (F.size("t") - real).cast("long").alias("padding"), real.alias("real"), F.size("t").cast("long").alias("slots"), F.array_max("t").cast("long").alias("last_target"))


@query("""WITH d AS (SELECT doc_id, n_chars % 300 AS n FROM documents), s AS (SELECT doc_id, (n + 3) // 4 AS c FROM d), u AS (SELECT doc_id, CASE WHEN c > 0 THEN 1 + (c - 1) // 4 * 4 ELSE 0 END AS k FROM s)
SELECT doc_id, k AS frames, CASE WHEN k > 0 THEN (k - 1) * 4 ELSE -1 END AS last_frame, CASE WHEN k > 0 THEN 1 + (k - 1) // 4 ELSE 0 END AS latents FROM u""")
def stride_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", sequences.sampled_frames(F.pmod("n_chars", F.lit(300))).alias("f"))
    k = F.size("f").cast("long")
    return rows.select("doc_id", k.alias("frames"), F.coalesce(F.array_max("f"), F.lit(-1)).alias("last_frame"), F.when(k > 0, sequences.latent_frames(k)).otherwise(0).cast("long").alias("latents"))


CAP = 81920
_MOST = sequences.most_segment_frames(CAP)
_PLAN = f"""d AS (SELECT doc_id, n_chars // 10 + 1 AS frames FROM documents), s AS (SELECT doc_id, frames, unnest(generate_series(0, frames - 2, {_MOST - 1})) AS start FROM d WHERE frames > 1),
p AS (SELECT doc_id, frames, start // {_MOST - 1} AS ordinal, start, least(start + {_MOST - 1}, frames - 1) AS stop FROM s)"""


@query(f"WITH {_PLAN} SELECT doc_id, ordinal::INT AS ordinal, start, stop, stop - start + 1 AS frame_count, (424 * (stop - start + 1) + 127) // 128 * 128 AS token_count FROM p")
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("n_chars") / F.lit(10)) + 1).alias("frames"))
    return sequences.plan_segments(rows, "frames", CAP, ["doc_id"]).select("doc_id", "ordinal", "start", "stop", "frame_count", "token_count")


@query(f"""WITH {_PLAN}, k AS (SELECT * FROM p WHERE NOT (doc_id % 3 = 0 AND ordinal = 1) AND NOT (doc_id % 5 = 0 AND ordinal = 0)),
c AS (SELECT *, lead(start) OVER w AS nx, row_number() OVER w - 1 AS rn, min(start) OVER (PARTITION BY doc_id) AS f, max(stop) OVER (PARTITION BY doc_id) AS l FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal, start))
SELECT doc_id, ordinal::INT AS ordinal, 'gap' AS rule FROM c WHERE nx IS NOT NULL AND nx <> stop UNION ALL SELECT doc_id, ordinal::INT, 'ordinal' FROM c WHERE rn <> ordinal
UNION ALL SELECT doc_id, ordinal::INT, 'start' FROM c WHERE rn = 0 AND f <> 0 UNION ALL SELECT doc_id, ordinal::INT, 'cover' FROM c WHERE rn = 0 AND l <> frames - 1""")
def segment_contiguity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a plan from which some segments were taken."""
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("n_chars") / F.lit(10)) + 1).alias("frames"))
    plan = sequences.plan_segments(rows, "frames", CAP, ["doc_id"])
    holed = plan.filter(~((F.col("doc_id") % 3 == 0) & (F.col("ordinal") == 1)) & ~((F.col("doc_id") % 5 == 0) & (F.col("ordinal") == 0)))
    return sequences.contiguity_violations(holed, ["doc_id"], "frames")


@query(f"WITH {roles.SERIES}, n AS (SELECT user_id, t, event_id % 9 + 1 AS length FROM series) SELECT user_id, t, length, (sum(length) OVER (PARTITION BY user_id ORDER BY t) - length)::BIGINT AS \"offset\" FROM n")
def frame_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.series(spark, sf_dir).select("user_id", "t", (F.pmod("event_id", F.lit(9)) + 1).alias("length"))
    return sequences.frame_offsets(rows, "length", USER, STEP)


@query(f"WITH {roles.SERIES} SELECT user_id, t, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY t), 6) AS running_rate, round(avg(value) OVER (PARTITION BY user_id ORDER BY t ROWS 50 PRECEDING), 8) AS recent FROM series")
def running_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running rate of hits, and a sliding mean of the last rows."""
    rows = sequences.running_rate(roles.series(spark, sf_dir), F.col("event_type") == "purchase", USER, STEP)
    return sequences.sliding_mean(rows, "value", USER, STEP, 50, "recent").select("user_id", "t", _r("running_rate"), _r("recent", 8))


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT a.label, a.vec_id, a.v, b.v AS b, row_number() OVER (PARTITION BY a.label, a.vec_id ORDER BY b.vec_id DESC) AS k
 FROM e a JOIN e b ON a.label = b.label AND b.vec_id <= a.vec_id), w AS (SELECT label, vec_id, b[1] AS b1, exp(0.5 * list_cosine_similarity(v, b)) AS w FROM h WHERE k <= 4)
SELECT label, vec_id, round(sum(w * b1) / sum(w), 6) AS first_channel FROM w GROUP BY 1, 2""")
def adaptive_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax-weighted mean of the last four vectors of a label."""
    rows = sequences.adaptive_ensemble(roles.table(spark, sf_dir, "embeddings"), "embedding", ["label"], ["vec_id"], 4, 0.5)
    return rows.select("label", "vec_id", F.round(F.col("ensemble")[0], 6).alias("first_channel"))


@query("SELECT (c - 1)::INT AS channel, round(q[1], 6) AS q01, round(q[2], 6) AS q99, n AS non_finite FROM (SELECT c, quantile_cont(x::DOUBLE, [0.01, 0.99]) AS q, count(*) FILTER (NOT isfinite(x)) AS n FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS c FROM embeddings) GROUP BY 1)")
def channel_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.channel_quantiles(roles.table(spark, sf_dir, "embeddings"), "embedding").select("channel", _r("q01"), _r("q99"), "non_finite")


@query("""WITH q AS (SELECT c - 1 AS channel, quantile_cont(x::DOUBLE, [0.01, 0.99]) AS q FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS c FROM embeddings) GROUP BY 1), m AS (SELECT i AS model_channel, CASE WHEN i BETWEEN 14 AND 32 THEN i - 14 END AS channel FROM range(0, 40) r(i))
SELECT m.model_channel::INT AS model_channel, round(CASE WHEN m.channel IS NULL OR m.channel = 18 THEN -1.0 ELSE q.q[1] END, 6) AS q01, round(CASE WHEN m.channel IS NULL OR m.channel = 18 THEN 1.0 ELSE q.q[2] END, 6) AS q99 FROM m LEFT JOIN q USING (channel)""")
def model_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel quantiles scattered to the model's channels; a fixed one and the unmapped ones are -1 and 1."""
    q = sequences.channel_quantiles(roles.table(spark, sf_dir, "embeddings"), "embedding")
    return sequences.model_quantiles(q, {k: 14 + k for k in range(19)}, {18}, 40).select("model_channel", _r("q01"), _r("q99"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, [0.01, 0.99]) AS q FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, least(greatest((l_quantity - q[1]) / (q[2] - q[1] + 1e-6) * 2 - 1, -1.5), 1.5) AS x, q FROM lineitem JOIN q USING (l_returnflag))
SELECT l_orderkey, l_partkey, l_suppkey, round(x, 6) AS normal, round((x + 1) / 2 * (q[2] - q[1] + 1e-6) + q[1], 6) AS back FROM n""")
def quantile_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile normalisation and its inverse, by return flag."""
    rows = roles.table(spark, sf_dir, "lineitem")
    q = rows.groupBy(F.col("l_returnflag").alias("g")).agg(F.percentile("l_quantity", F.lit(0.01)).alias("lo"), F.percentile("l_quantity", F.lit(0.99)).alias("hi"))
    joined = rows.join(F.broadcast(q), F.col("l_returnflag") == F.col("g"))  # three flags
    out = joined.withColumn("normal", scalars.quantile_normalise("l_quantity", "lo", "hi"))
    return out.select("l_orderkey", "l_partkey", "l_suppkey", _r("normal"), F.round(scalars.quantile_denormalise("normal", "lo", "hi"), 6).alias("back"))


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER ()) / greatest(stddev_pop(s_acctbal) OVER (), 1e-4), 6) AS s_acctbal_std FROM supplier")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "supplier").withColumn("g", F.lit(0))
    return sequences.standardised(rows, "s_acctbal", ["g"]).select("s_suppkey", _r("s_acctbal_std"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, a, b, list_distance(a, b) AS l2, [abs(x[1] - x[2]) for x in list_zip(a, b)] AS e FROM p)
SELECT vec_id, round(l2, 6) AS l2, round(sqrt(l2 * l2 / len(a)), 6) AS rmse, round(list_avg(e), 6) AS mae, round(list_max(e), 6) AS max_abs, round(list_cosine_similarity(a, b), 6) AS cosine FROM d""")
def vector_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pairs.select("vec_id", *[F.round(f("a", "b"), 6).alias(n) for n, f in (
        ("l2", vectors.distance), ("rmse", vectors.rmse), ("mae", vectors.mean_abs), ("max_abs", vectors.max_abs), ("cosine", vectors.cosine))])


@query("""WITH e AS (SELECT event_id, event_id % 60 * 0.1 - 3 AS r, event_id % 29 * 0.1 - 1.4 AS p, event_id % 61 * 0.1 - 3 AS y FROM events) SELECT event_id, round(r, 6) AS roll, round(p, 6) AS pitch, round(y, 6) AS yaw, true AS unit, true AS rotation FROM e""")
def rotation_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler angles to quaternions to matrices and back."""
    e = roles.table(spark, sf_dir, "events").select("event_id", *[(F.pmod("event_id", F.lit(n)) * 0.1 - o).alias(c) for c, n, o in (("r", 60, 3), ("p", 29, 1.4), ("y", 61, 3))])
    q = e.withColumn("q", vectors.euler_to_quaternion("r", "p", "y")).withColumn("m", vectors.quaternion_to_matrix("q"))
    out = q.withColumn("a", vectors.matrix_to_euler("m"))
    return out.select("event_id", *[F.round(F.col("a")[i], 6).alias(c) for i, c in enumerate(("roll", "pitch", "yaw"))], (F.abs(vectors.norm("q") - 1) < 1e-9).alias("unit"), vectors.is_rotation("m").alias("rotation"))


_TOKENS = "tok AS (SELECT user_id AS seq, event_id AS token, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS frame, event_type IN ('error', 'purchase') AS noisy, user_id % 3 + 1 AS win FROM events)"


@query(f"""WITH {_TOKENS} SELECT q.seq, q.token AS q_token, k.token AS k_token FROM tok q JOIN tok k ON q.seq = k.seq AND abs(q.frame - k.frame) <= q.win
 AND ((NOT q.noisy AND NOT k.noisy AND k.frame <= q.frame) OR (q.noisy AND NOT k.noisy AND k.frame < q.frame) OR (q.noisy AND k.noisy AND k.frame = q.frame))""")
def mask_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.series(spark, sf_dir).select(
        F.col("user_id").alias("seq"), F.col("event_id").alias("token"), F.floor(F.col("t") / F.lit(4)).cast("long").alias("frame"),
        F.col("event_type").isin("error", "purchase").alias("noisy"), (F.pmod("user_id", F.lit(3)) + 1).alias("window"))
    return sequences.mask_pairs(rows)


@query("SELECT event_id % 200 AS step, arg_max(event_id % 1000, event_id)::DOUBLE AS eff_labels, arg_max(round(value, 3), event_id) AS total_loss FROM events GROUP BY 1")
def log_regex_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric lines of a log, scanned by patterns; the last line of a step wins. Carriage returns end lines as well."""
    text = F.format_string("2026-01-02 03:04:05 Training: total_loss=%.3f, step=%d, eff_labels=%d\rprogress", F.col("value"), F.pmod("event_id", F.lit(200)), F.pmod("event_id", F.lit(1000)))
    return readers.last_by_step(_logged(spark, sf_dir, text), ["eff_labels", "total_loss"], "at")


def _logged(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """Events as the files of one log, in their order, and its lines with their place."""
    path = scratch.place(spark, "log")
    rows = roles.table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    return readers.log_lines(spark, path).select("line", F.struct("file", "n").alias("at"))


@query("SELECT (event_id % 20)::DOUBLE AS step, (user_id % 4)::DOUBLE AS mem_gb, min(event_id) AS n FROM events GROUP BY 1, 2")
def log_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without repeats of the same values; which event wrote the first of them."""
    text = F.format_string("step=%d, mem_gb=%d, event=%d", F.pmod("event_id", F.lit(20)), F.pmod("user_id", F.lit(4)), F.col("event_id"))
    lines = _logged_events(spark, sf_dir, text)
    return readers.first_of_tuple(lines, ["step", "mem_gb"], "at").select("step", "mem_gb", F.col("at.event").cast("long").alias("n"))


def _logged_events(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    lines = _logged(spark, sf_dir, text)
    return lines.select("line", F.struct("at.file", "at.n", readers.metric("line", "event").alias("event")).alias("at"))


@query("SELECT (user_id % 8)::INT AS gpu, round(max(round(value, 2)), 2) AS peak_mib FROM events WHERE event_id % 11 <> 0 GROUP BY 1")
def gpu_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitor lines with six fields; shorter ones are skipped."""
    full = F.format_string("2026/01/02 03:04:05, %d, %.2f MiB, 81920 MiB, 99 %%, 300 W", F.pmod("user_id", F.lit(8)), F.col("value"))
    lines = _logged(spark, sf_dir, F.when(F.col("event_id") % 11 == 0, "index, memory.used").otherwise(full))
    return readers.gpu_peaks(lines).withColumn("peak_mib", F.round("peak_mib", 2))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, round((floor(epoch(max(ts) OVER ())) - floor(epoch(ts))) / 3600, 4) AS hours_to_end FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON property, and the hours to the last event."""
    rows = roles.table(spark, sf_dir, "events")
    last = rows.agg(F.max("ts").alias("last"))
    return rows.crossJoin(F.broadcast(last)).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(scalars.span_hours("ts", "last"), 4).alias("hours_to_end"))  # one row


@query("SELECT doc_id, printf('data/chunk-%03d/episode_%06d.parquet', doc_id // 100, doc_id) AS path, concat_ws('|', source, lang, doc_id) AS sample_key, (424 * (n_chars % 500) + 127) // 128 * 128 AS tokens FROM documents")
def path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "documents").select("doc_id", scalars.episode_path("doc_id", 100).alias("path"), scalars.sample_key("source", "lang", "doc_id").alias("sample_key"), scalars.episode_tokens(F.pmod("n_chars", F.lit(500))).alias("tokens"))


@query("""WITH b AS (SELECT i AS step, 1.0 - i / 1000.0 AS s FROM range(0, 1000) r(i)), g AS (SELECT step, 5.0 * s / (1 + 4.0 * s) AS sigma FROM b), w AS (SELECT step, sigma, exp(-2 * ((sigma * 1000 - 500) / 1000) ** 2) AS y FROM g)
SELECT step, round(sigma, 6) AS sigma, round((y - min(y) OVER ()) / (avg(y) OVER () - min(y) OVER ()), 6) AS weight FROM w""")
def noise_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalars.schedule(spark, 1000, 5.0).select("step", _r("sigma"), _r("weight"))


@query("SELECT o_orderkey, ('run_' || o_orderstatus || '_b' || (o_orderkey % 100)) AS name, 'run_' || o_orderstatus AS selector, (o_orderkey % 100) / 100.0::DOUBLE AS budget, least(1.0, o_orderkey / 5000.0)::DOUBLE AS ramp, sign(1 - 2 * (o_orderkey % 3))::DOUBLE AS gripper FROM orders")
def scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name parsing, warm-up ramp and gripper signs."""
    name = F.concat(F.lit("run_"), "o_orderstatus", F.lit("_b"), F.pmod("o_orderkey", F.lit(100)).cast("string"))
    return roles.table(spark, sf_dir, "orders").withColumn("name", name).select(
        "o_orderkey", "name", scalars.selector_of("name").alias("selector"), scalars.budget_of("name").alias("budget"), scalars.ramp("o_orderkey", 5000).alias("ramp"), scalars.gripper_sign(F.pmod("o_orderkey", F.lit(3))).cast("double").alias("gripper"))


@query()
def stateless_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLAKE2b seeds; SQL has no such hash (tested against the plain definition)."""
    seed = scalars.stateless_seed(42, "doc_id", "window")
    return roles.table(spark, sf_dir, "documents").select("doc_id", seed.alias("seed"), (1 + F.pmod(seed, F.lit(4))).alias("chunk"), scalars.stateless_uniform(42, "doc_id", "gate").alias("u"))
