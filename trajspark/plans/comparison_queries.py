"""Differences, set operations and quality rules over the stock tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import diff, packing, quality
from . import roles
from .registry import query

_RUNS = """l AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
 o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = roles.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    right = o.filter("o_orderkey % 7 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_totalprice": F.col("o_totalprice") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)})
    return o.filter("o_orderkey % 10 <> 0"), right


_DIFF = f"""{_RUNS}, d AS (SELECT o_orderkey, CASE WHEN r.o_orderkey IS NULL THEN 'missing' WHEN l.o_orderkey IS NULL THEN 'extra' WHEN l.o_orderstatus <> r.o_orderstatus OR l.o_totalprice <> r.o_totalprice THEN 'changed' END AS status,
 CASE WHEN l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL THEN concat_ws(',', CASE WHEN l.o_orderstatus <> r.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN l.o_totalprice <> r.o_totalprice THEN 'o_totalprice' END) ELSE '' END AS fields
 FROM l FULL JOIN r USING (o_orderkey))"""


@query(f"WITH {_DIFF} SELECT * FROM d WHERE status IS NOT NULL")
def run_diff_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.compare(*_runs(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return found.withColumn("fields", F.array_join("fields", ","))


@query(f"WITH {_DIFF} SELECT count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra, count(*) FILTER (status = 'changed') AS changed, min(o_orderkey) FILTER (status IS NOT NULL) AS first_key FROM d")
def run_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff.compare(*_runs(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    first = diff.first_difference(found, ["o_orderkey"]).select(F.col("o_orderkey").alias("first_key"))
    return diff.summary(found).crossJoin(first)  # one row each


@query("""WITH l AS (SELECT p_partkey, p_brand, p_type, p_size FROM part), r AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN 'X' ELSE p_type END AS p_type, CASE WHEN p_partkey % 75 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 100 <> 1)
SELECT p_partkey, CASE WHEN r.p_partkey IS NULL THEN 'missing' ELSE 'changed' END AS status, coalesce((l.p_type <> r.p_type)::INT + (l.p_size <> r.p_size)::INT, 0) AS n FROM l LEFT JOIN r USING (p_partkey) WHERE r.p_partkey IS NULL OR l.p_type <> r.p_type OR l.p_size <> r.p_size""")
def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = roles.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    right = left.filter("p_partkey % 100 <> 1").withColumns({
        "p_type": F.when(F.col("p_partkey") % 50 == 0, "X").otherwise(F.col("p_type")), "p_size": F.when(F.col("p_partkey") % 75 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))})
    found = diff.compare(left, right, ["p_partkey"], ["p_brand", "p_type", "p_size"])
    return found.select("p_partkey", "status", F.size("fields").alias("n"))


@query("""WITH l AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place, user_id AS sig FROM events), r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS place, user_id AS sig FROM events WHERE event_id % 1000 <> 5)
SELECT event_type, count(*) FILTER (r.place IS NULL) AS missing, count(*) FILTER (l.sig <> r.sig) AS changed FROM l LEFT JOIN r USING (event_type, place) GROUP BY 1""")
def positional_signature_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = roles.table(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").alias("sig"))
    right = left.filter("event_id % 1000 <> 5")
    found = diff.compare_positions(left, right, ["event_type"], ["event_id"], "sig")
    types = left.select("event_type").distinct()
    counted = found.groupBy("event_type").agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "changed").alias("changed"))
    return types.join(counted, "event_type", "left").fillna(0)


@query(f"WITH {_RUNS} SELECT count(*) FILTER (l.o_orderkey IS NOT NULL AND r.o_orderkey IS NOT NULL) AS common, count(*) FILTER (r.o_orderkey IS NULL) AS only_left, count(*) FILTER (l.o_orderkey IS NULL) AS only_right, round(max(abs(l.o_totalprice - r.o_totalprice)), 4) AS max_o_totalprice FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey")
def progress_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs joined on their step, with the greatest difference."""
    return diff.metric_differences(*_runs(spark, sf_dir), "o_orderkey", ["o_totalprice"]).withColumn("max_o_totalprice", F.round("max_o_totalprice", 4))


@query("""WITH j AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 0.01 ELSE 0 END AS d, p_retailprice AS v FROM part), m AS (SELECT * FROM j ORDER BY d DESC, p_partkey DESC LIMIT 1)
SELECT round(d, 6) AS max_abs, p_partkey AS max_key, round(d / v, 6) AS max_key_relative, (SELECT min(p_partkey) FROM j WHERE d > 0) AS first_differing FROM m""")
def greatest_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = roles.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    right = left.withColumn("p_retailprice", F.col("p_retailprice") + F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") * 0.01).otherwise(0.0))
    out = diff.greatest_change(left, right, "p_partkey", "p_retailprice")
    return out.withColumns({"max_abs": F.round("max_abs", 6), "max_key_relative": F.round("max_key_relative", 6)})


@query("SELECT doc_id, 'missing' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def manifest_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.missing_and_extra(roles.table(spark, sf_dir, "documents"), roles.table(spark, sf_dir, "labels"), ["doc_id"])


@query("""WITH c AS (SELECT unnest(['left', 'right', 'top']) AS camera), e AS (SELECT DISTINCT vec_id, camera FROM embeddings, c), a AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'top' END AS camera FROM embeddings)
SELECT camera, count(*) AS missing FROM (SELECT * FROM e EXCEPT SELECT * FROM a) GROUP BY 1""")
def camera_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes x cameras as the expected keys against what there is."""
    e = roles.table(spark, sf_dir, "embeddings")
    cameras = spark.createDataFrame([("left",), ("right",), ("top",)], "camera string")
    expected = quality.expected_keys(e.select("vec_id"), cameras)
    label = F.pmod("label", F.lit(3))
    actual = e.select("vec_id", F.when(label == 0, "left").when(label == 1, "right").otherwise("top").alias("camera"))
    found = diff.missing_and_extra(expected, actual, ["vec_id", "camera"])
    return found.filter("status = 'missing'").groupBy("camera").agg(F.count(F.lit(1)).alias("missing"))


_MANIFEST = """f AS (SELECT CASE WHEN doc_id % 97 = 0 THEN '../' ELSE '' END || 'part-' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256, doc_id FROM documents),
m AS (SELECT path, size + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN doc_id % 40 = 0 THEN 'xyz' ELSE sha256 END AS sha256 FROM f WHERE doc_id % 60 <> 0), k AS (SELECT * FROM f WHERE doc_id % 70 <> 0)"""


@query(f"""WITH {_MANIFEST}, j AS (SELECT coalesce(m.path, k.path) AS path, m.size AS ms, k.size AS ks, m.sha256 AS mh, k.sha256 AS kh FROM m FULL JOIN k ON m.path = k.path)
SELECT path AS key, 'unsafe_path' AS rule FROM m WHERE path LIKE '../%' UNION ALL SELECT path, 'bad_digest' FROM m WHERE NOT regexp_full_match(sha256, '[0-9a-fA-F]{{64}}')
UNION ALL SELECT path, 'missing_file' FROM j WHERE kh IS NULL UNION ALL SELECT path, 'unlisted_file' FROM j WHERE mh IS NULL UNION ALL SELECT path, 'size' FROM j WHERE ms <> ks UNION ALL SELECT path, 'digest' FROM j WHERE mh <> kh""")
def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest with planted faults against its files."""
    d = roles.table(spark, sf_dir, "documents")
    prefix = F.when(F.col("doc_id") % 97 == 0, "../").otherwise("")
    files = d.select(F.concat(prefix, F.lit("part-"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id")
    manifest = files.filter("doc_id % 60 <> 0").select(
        "path", (F.col("size") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("doc_id") % 40 == 0, "xyz").otherwise(F.col("sha256")).alias("sha256"))
    return quality.manifest_rules(manifest, files.filter("doc_id % 70 <> 0"))


@query("""WITH e AS (SELECT doc_id AS episode_index, n_chars % 50 AS length, n_chars % 50 - (doc_id % 20 = 0)::INT AS fin, CASE WHEN doc_id % 30 = 0 THEN 2 ELSE 1 END AS tasks FROM documents UNION ALL SELECT doc_id, 10, 10, 1 FROM documents WHERE doc_id % 333 = 0), c AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM e)
SELECT episode_index::VARCHAR AS key, 'duplicate_episode' AS rule FROM c WHERE n > 1 UNION ALL SELECT episode_index::VARCHAR, 'too_short' FROM c WHERE length <= 1 UNION ALL SELECT episode_index::VARCHAR, 'not_covering' FROM c WHERE fin <> length UNION ALL SELECT episode_index::VARCHAR, 'not_one_task' FROM c WHERE tasks <> 1""")
def episode_metadata_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = roles.table(spark, sf_dir, "documents").select("doc_id", F.pmod("n_chars", F.lit(50)).alias("length"))

    def config(end):
        return F.array(F.struct(F.lit(0).cast("long").alias("start_frame"), end.cast("long").alias("end_frame")))

    rows = d.select(F.col("doc_id").alias("episode_index"), "length", config(F.col("length") - (F.col("doc_id") % 20 == 0).cast("int")).alias("action_config"),
                    F.when(F.col("doc_id") % 30 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("tasks"))
    again = d.filter("doc_id % 333 = 0").select(F.col("doc_id").alias("episode_index"), F.lit(10).cast("long").alias("length"), config(F.lit(10)).alias("action_config"), F.array(F.lit("a")).alias("tasks"))
    return quality.episode_rules(rows.unionByName(again))


@query("WITH g AS (SELECT source, count(DISTINCT lang) AS n, count(DISTINCT n_chars % 2) AS m FROM documents GROUP BY 1) SELECT source AS key, 'differing_lang' AS rule FROM g WHERE n > 1 UNION ALL SELECT source, 'differing_parity' FROM g WHERE m > 1")
def shape_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = roles.table(spark, sf_dir, "documents").select("source", "lang", F.pmod("n_chars", F.lit(2)).alias("parity"))
    return quality.agreement(rows, "source", ["lang", "parity"])


@query("SELECT o_custkey AS customer FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 3")
def complete_camera_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have all members (all cameras, here all statuses)."""
    return quality.complete_groups(roles.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer"), ["customer"], "o_orderstatus", 3)


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'semi', count(*) FROM a WHERE k IN (SELECT k FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = roles.table(spark, sf_dir, "lineitem")
    a, b = (li.filter(c).select(F.col("l_suppkey").alias("k")).distinct() for c in ("l_quantity > 49", "l_discount > 0.09"))
    parts = {"union": a.union(b).distinct(), "union_all": a.unionByName(b), "intersect": a.intersect(b), "except": a.exceptAll(b), "semi": a.join(b, "k", "left_semi")}
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n") for name, df in parts.items()]
    return quality.union(*out)


@query("SELECT d.doc_id, coalesce(l.n_chars = d.n_chars, false) AS reuse FROM documents d LEFT JOIN (SELECT doc_id, n_chars + (doc_id % 9 = 0)::INT AS n_chars FROM documents WHERE doc_id % 4 <> 0) l USING (doc_id)")
def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts whose recorded source is unchanged; the rest is to be computed anew."""
    current = roles.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    recorded = current.filter("doc_id % 4 <> 0").withColumn("n_chars", F.col("n_chars") + (F.col("doc_id") % 9 == 0).cast("long"))
    return diff.reusable(current, recorded, "doc_id", ["n_chars"])


@query("SELECT l_orderkey % 100 AS rank, l_linenumber AS step, count(*) AS n, max(l_partkey) AS last FROM lineitem GROUP BY ALL")
def keyed_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key by its order."""
    rows = roles.table(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(100)).alias("rank"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("last"), F.col("l_partkey").alias("at"))
    counts = rows.groupBy("rank", "step").agg(F.count(F.lit(1)).alias("n"))
    return diff.last_by_key(rows, ["rank", "step"], "at").join(counts, ["rank", "step"]).select("rank", "step", "n", "last")


@query("SELECT page_id, regexp_full_match(sha256(url), '[0-9a-f]{64}') AS digest_ok, NOT (starts_with(url, '/') OR list_contains(string_split(url, '/'), '..') OR list_contains(string_split(url, '/'), '') OR list_contains(string_split(url, '/'), '.') OR url = '') AS safe FROM pages")
def path_and_digest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.table(spark, sf_dir, "pages").select(
        "page_id", scalars.is_sha256(F.sha2(F.col("url").cast("binary"), 256)).alias("digest_ok"), scalars.is_safe_relative_path("url").alias("safe"))


@query("SELECT event_id, event_id // 64 > 3 OR (event_id // 64 = 3 AND event_id % 64 >= 20) AS left_over FROM events")
def resume_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a resume at place 20 of epoch 3; later epochs are left as a whole."""
    rows = roles.table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / F.lit(64)).alias("epoch"), F.pmod("event_id", F.lit(64)).alias("place"))
    kept = packing.suffix(rows, 20, 3).select("event_id", F.lit(True).alias("kept"))
    return rows.select("event_id").join(kept, "event_id", "left").select("event_id", F.coalesce("kept", F.lit(False)).alias("left_over"))
