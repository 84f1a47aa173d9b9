"""Dataset-level operators over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets, sequences
from . import roles
from .registry import query
from .sequence_queries import _PLAN, CAP


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents")
    config = F.array_repeat(F.struct(F.lit(0).cast("long").alias("start_frame"), F.col("n_chars").alias("end_frame")), F.pmod("doc_id", F.lit(4)).cast("int"))
    return d.select(F.col("doc_id").alias("episode_index"), F.col("n_chars").alias("length"), F.array("source").alias("tasks"), config.alias("action_config"), F.col("lang").alias("dataset"))


@query("SELECT doc_id AS episode_index, n_chars AS length FROM documents WHERE doc_id >= 20 AND doc_id < 90")
def split_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.in_split(_episodes(spark, sf_dir), "20:90").select("episode_index", "length")


@query("SELECT doc_id AS episode_index FROM labels WHERE false UNION ALL SELECT i FROM range(0, 300) r(i) WHERE i NOT IN (SELECT doc_id FROM labels)")
def split_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.missing_from_split(roles.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "episode_index"), "0:300")


@query("WITH t AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id AS episode_index, CASE WHEN t.i < 3 THEN doc_id % 4 ELSE 0 END AS configs FROM documents JOIN t USING (source)")
def task_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes outside the first three tasks stay, with an empty list."""
    from pyspark.sql.window import Window

    e = _episodes(spark, sf_dir)
    names = e.select(F.element_at("tasks", 1).alias("task")).distinct()  # the task table has a row for each task
    tasks = names.withColumn("task_index", F.row_number().over(Window.orderBy("task")) - 1)
    return datasets.first_tasks(e, tasks, 3).select("episode_index", F.size("action_config").cast("long").alias("configs"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lookup that fails on an unknown key."""
    names = roles.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return datasets.lookup(roles.table(spark, sf_dir, "customer"), names, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.lookup_or_blank(roles.table(spark, sf_dir, "documents").select("doc_id"), roles.table(spark, sf_dir, "labels"), ["doc_id"], ["quality"])


@query("""WITH c AS (SELECT user_id AS child, count(*) AS length FROM events GROUP BY 1), o AS (SELECT child, length, coalesce(sum(length) OVER (ORDER BY child ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f FROM c)
SELECT event_id AS "index", child, event_id - f AS "local" FROM events JOIN o ON event_id >= f AND event_id < f + length""")
def global_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "events")
    children = e.groupBy(F.col("user_id").alias("child")).agg(F.count(F.lit(1)).alias("length"))
    return datasets.locate(e.select(F.col("event_id").alias("index")), children)


@query(f"WITH {_PLAN}, b AS (SELECT doc_id, count(*) AS n, sum(stop - start + 1) AS f, sum((424 * (stop - start + 1) + 127) // 128 * 128) AS t FROM p GROUP BY 1) SELECT count(*) AS parent_episodes, count(*) FILTER (n > 1) AS split_episodes, sum(n)::BIGINT AS segments, sum(f)::BIGINT AS virtual_segment_frames, sum(t)::BIGINT AS total_tokens FROM b")
def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "documents").select("doc_id", (F.floor(F.col("n_chars") / F.lit(10)) + 1).alias("frames"))
    return datasets.segment_totals(sequences.plan_segments(rows, "frames", CAP, ["doc_id"]), "doc_id")


@query("""WITH e AS (SELECT lang AS dataset, count(*) AS episodes, sum(n_chars)::BIGINT AS frames, sum(doc_id % 4)::BIGINT AS segments FROM documents GROUP BY 1), f AS (SELECT lang AS dataset, count(*) AS files FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT dataset, episodes, frames, segments, coalesce(files, 0) AS files, CASE WHEN coalesce(files, 0) = 0 THEN 'no_files' WHEN segments = 0 THEN 'no_segments' WHEN files < episodes THEN 'incomplete' ELSE 'ready' END AS status FROM e LEFT JOIN f USING (dataset)""")
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _episodes(spark, sf_dir)
    files = roles.table(spark, sf_dir, "labels").join(e, F.col("doc_id") == F.col("episode_index")).select("dataset")
    return datasets.audit(e, files, "dataset")


@query("""WITH c AS (SELECT source, lang, doc_id FROM documents), p AS (SELECT lang, count(l.doc_id) AS present, count(*) - count(l.doc_id) AS missing FROM c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1)
SELECT lang, present, missing, CASE WHEN present = 0 THEN 'absent' WHEN missing > 0 THEN 'partial' ELSE 'complete' END AS status FROM p""")
def latent_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents").select("lang", "doc_id")
    have = d.join(roles.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return datasets.presence(d, have, ["lang", "doc_id"], "lang")


@query("""WITH n AS (SELECT sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS n FROM embeddings), h AS (SELECT string_agg(label || ':' || c, ',' ORDER BY label || ':' || c) AS histogram FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY 1))
SELECT round(quantile_cont(n, 0.5), 6) AS norm_p50, round(quantile_cont(n, 0.95), 6) AS norm_p95, round(max(n), 6) AS norm_max, any_value(histogram) AS histogram FROM n, h""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.trace_summary(roles.table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.withColumns({c: F.round(c, 6) for c in ("norm_p50", "norm_p95", "norm_max")})


@query("SELECT min(value) AS least, max(value) AS most, arg_min(value, ts) AS first, arg_max(value, ts) AS last FROM events")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.first_and_last(roles.table(spark, sf_dir, "events"), "ts", "value")


@query("""WITH l AS (SELECT s_suppkey AS k, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier), r AS (SELECT k, x + k % 5 AS x, y - k % 3 AS y FROM l), d AS (SELECT l.k, sqrt((r.x - l.x) ** 2 + (r.y - l.y) ** 2) AS d FROM l JOIN r USING (k))
SELECT round(sum(d), 6) AS total, round(max(d), 6) AS most, round(max(d) FILTER (k = 7), 6) AS of_target FROM d""")
def layout_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    right = left.select("k", (F.col("x") + F.pmod("k", F.lit(5))).alias("x"), (F.col("y") - F.pmod("k", F.lit(3))).alias("y"))
    out = datasets.displacement(left, right, "k", 7)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""WITH p AS (SELECT event_id, value, 'zero' AS kind, 0 AS p FROM (SELECT * FROM events WHERE event_type = 'error' ORDER BY value, event_id LIMIT 1) UNION ALL SELECT event_id, value, 'tail', 1 FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 1)
UNION ALL SELECT event_id, value, 'first', 2 FROM (SELECT * FROM events ORDER BY event_id LIMIT 20)) SELECT event_id, value, kind FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p) AS r FROM p) WHERE r = 1 ORDER BY p, event_id LIMIT 30""")
def example_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of at most 30 rows for people to look at."""
    rows = roles.table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    kinds = {"zero": (F.col("event_type") == "error", F.col("value")), "tail": (F.lit(True), F.desc("value"))}
    return datasets.examples(rows, "event_id", kinds, 20, 30).select("event_id", "value", "kind")


@query("WITH r AS (SELECT n_nationkey, n_name, n_regionkey FROM nation) SELECT sha256(string_agg('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}', chr(10) ORDER BY n_nationkey)) AS fingerprint FROM r")
def manifest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.manifest_fingerprint(roles.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query()
def segment_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests over float32 bytes; SQL can't pack them (tested against numpy)."""
    e = roles.table(spark, sf_dir, "embeddings")
    mask = F.transform("embedding", lambda x: x > 0)
    return e.select("vec_id", datasets.segment_digest(F.array("embedding"), F.array(mask)).alias("digest"))


@query("""WITH s AS (SELECT p_partkey, p_brand, p_size + (p_partkey % 10 = 0)::INT AS p_size FROM part WHERE p_partkey % 9 <> 0) SELECT p.p_partkey, (s.p_partkey IS NOT NULL)::BIGINT AS matches, coalesce(p.p_brand = s.p_brand, false) AS brand, coalesce(p.p_size = s.p_size, false) AS size FROM part p LEFT JOIN s USING (p_partkey)""")
def reference_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roles.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    stored = p.filter("p_partkey % 9 <> 0").withColumn("p_size", F.col("p_size") + (F.col("p_partkey") % 10 == 0).cast("int"))
    out = datasets.validate_reference(p, stored, ["p_partkey"], ["p_brand", "p_size"])
    return out.select("p_partkey", F.col("matches").cast("long").alias("matches"), F.col("equal")["p_brand"].alias("brand"), F.col("equal")["p_size"].alias("size"))


_RESPONSE = """e AS (SELECT label, vec_id, embedding::DOUBLE[] AS a, [x * (1 + vec_id % 3) + 0.01 * label for x in embedding::DOUBLE[]] AS b FROM embeddings), d AS (SELECT label, vec_id, a, b, [x[2] - x[1] for x in list_zip(a, b)] AS d FROM e),
f AS (SELECT *, first_value(d) OVER (PARTITION BY label ORDER BY vec_id) AS d0, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM d)"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = roles.table(spark, sf_dir, "embeddings")
    b = F.transform("embedding", lambda x: x.cast("double") * (1 + F.pmod("vec_id", F.lit(3))) + 0.01 * F.col("label"))
    return e.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("a"), b.alias("b"))


@query(f"WITH {_RESPONSE} SELECT label, round(avg(sqrt(list_sum([y * y for y in d]) / len(d))), 6) AS rmse, round(avg(list_avg([abs(y) for y in d])), 6) AS mean_abs, round(max(list_max([abs(y) for y in d])), 6) AS max_abs, round(avg(list_cosine_similarity(a, b)), 6) AS cosine FROM f WHERE r > 1 GROUP BY 1")
def plan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.plan_delta(_responses(spark, sf_dir), ["label"], "vec_id", "a", "b")
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("rmse", "mean_abs", "max_abs", "cosine")])


@query(f"""WITH {_RESPONSE}, g AS (SELECT label, vec_id, sqrt(list_sum([y * y for y in d])) / nullif(sqrt(list_sum([y * y for y in d0])), 0) AS gain, list_sum([x[1] * x[2] for x in list_zip(d, d0)]) / nullif(list_sum([y * y for y in d0]), 0) AS retained FROM f WHERE r > 1)
SELECT label, round(avg(gain), 6) AS mean_gain, round(avg(retained), 6) AS mean_retained, round(arg_max(gain, vec_id), 6) AS last_gain, round(arg_max(retained, vec_id), 6) AS last_retained FROM g GROUP BY 1""")
def layout_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.layout_response(_responses(spark, sf_dir).filter("label > 0"), ["label"], "vec_id", "a", "b")
    zero = datasets.layout_response(_responses(spark, sf_dir).filter("label = 0"), ["label"], "vec_id", "a", "b")
    both = out.unionByName(zero)
    return both.select("label", *[F.round(c, 6).alias(c) for c in ("mean_gain", "mean_retained", "last_gain", "last_retained")])


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.9) AS q FROM lineitem GROUP BY 1) SELECT l_returnflag, round(avg(l_quantity) FILTER (l_quantity >= q), 6) AS inside, round(avg(l_quantity) FILTER (l_quantity < q), 6) AS outside, round(avg(l_tax) FILTER (l_quantity >= q) / avg(l_quantity) FILTER (l_quantity >= q), 6) AS preserved
FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def masked_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.masked_motion(roles.table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax")
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("inside", "outside", "preserved")])


@query("WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id FROM events) SELECT event_id, t FROM s WHERE t >= user_id % 10 AND t < user_id % 10 + 5")
def row_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one span of each episode."""
    spans = roles.lengths(spark, sf_dir).select(F.col("episode").alias("user_id"), F.pmod("episode", F.lit(10)).alias("start"), (F.pmod("episode", F.lit(10)) + 5).alias("end"))
    return datasets.episode_rows(roles.series(spark, sf_dir), spans, "user_id", "t").select("event_id", "t")
