"""Streaming operators run to the end of what is there (availableNow), over the stock tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..streaming import ledger, streams
from . import roles
from .registry import query


def _ledger(spark: SparkSession) -> tuple[ledger.Ledger, str]:
    """A ledger and a checkpoint of their own in the folder that driver and executors share."""
    return ledger.Ledger(spark, scratch.place(spark, "ledger")), scratch.place(spark, "stream")


def _arriving(rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """A table as a stream of ``parts`` batches: each part is written as two files after the ones before."""
    spark = rows.sparkSession
    path = scratch.place(spark, "arriving")
    for n in range(parts):
        rows.filter(part == n).repartition(2).write.mode("append").parquet(path)
    return streams.files(spark, path, rows.schema, 2)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob: a stream's path must not be a single file
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@query("SELECT event_id, event_id % 3 AS training_attempt_id, event_id // 100 AS optimizer_step FROM events WHERE (event_id // 100) % 4 <> 3")
def stream_commit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records released by their step's commit: a stream-stream join with watermarks. Every fourth step is never committed."""
    step = F.floor(F.col("event_id") / F.lit(100)).cast("long")
    keyed = _events(spark, sf_dir).select("event_id", F.pmod("event_id", F.lit(3)).alias("training_attempt_id"), step.alias("optimizer_step"), F.col("ts").cast("timestamp").alias("at"))
    commits = _events(spark, sf_dir).filter("event_id % 100 < 3").select(
        F.pmod("event_id", F.lit(3)).alias("training_attempt_id"), step.alias("optimizer_step"), (F.col("ts") + F.expr("interval 20 days")).cast("timestamp").alias("at")).filter("optimizer_step % 4 <> 3")
    joined = streams.commit_join(keyed, commits, "40 days").select("event_id", "training_attempt_id", "optimizer_step")
    book, checkpoint = _ledger(spark)
    ledger.finish(ledger.into(joined, book, checkpoint))
    return book.read("rows", ledger.schema_of(joined)).drop("batch")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def stream_bounded_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the five latest slots of each user, with the lowest id evicted."""
    stream = _events(spark, sf_dir).select("user_id", "event_id", "value")
    cache = streams.latest_n(stream, "user_id", "event_id", "value", 5)
    book, checkpoint = _ledger(spark)
    ledger.finish(ledger.into(cache, book, checkpoint, mode="update"))
    rows = book.read("rows", ledger.schema_of(cache))
    # what stands is the content that a user's last batch left
    latest = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["user_id", "batch"]).select("user_id", "event_id", "value")


@query("SELECT user_id AS occurrence_id, max(event_id) AS resume_generation FROM events GROUP BY 1")
def stream_latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _events(spark, sf_dir).select(F.col("user_id").alias("occurrence_id"), F.col("event_id").alias("resume_generation"))
    found = streams.latest_generation(stream)
    book, checkpoint = _ledger(spark)
    ledger.finish(ledger.into(found, book, checkpoint, mode="update"))
    return book.read("rows", ledger.schema_of(found)).groupBy("occurrence_id").agg(F.max("resume_generation").alias("resume_generation"))


@query("SELECT l_orderkey AS occurrence_id, l_linenumber AS resume_generation, l_partkey, l_quantity FROM lineitem l WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)")
def stream_replaced_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in three batches without order: later generations take back what earlier batches had accepted."""
    rows = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("occurrence_id"), F.col("l_linenumber").cast("long").alias("resume_generation"), "l_partkey", "l_quantity")
    book, checkpoint = _ledger(spark)
    ledger.finish(ledger.run_changes(_arriving(rows, F.pmod("l_partkey", F.lit(3)), 3), book, checkpoint))
    return ledger.replaced(book.read("rows", f"op string, {ledger.schema_of(rows)}"))


_GAP = 4321


@query(f"""WITH u AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 5000 <> {_GAP}),
c AS (SELECT min(k) AS next_update FROM (SELECT o_orderkey + 1 AS k FROM u UNION SELECT 0) WHERE k NOT IN (SELECT o_orderkey FROM u))
SELECT o_orderstatus, next_update, count(*) AS updates, sum(o_orderkey)::BIGINT AS id_sum FROM u, c WHERE o_orderkey < next_update GROUP BY ALL""")
def stream_update_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates in four batches without order: the cursor moves with each commit up to the first update that is missing."""
    rows = roles.table(spark, sf_dir, "orders").filter(f"o_orderkey % 5000 <> {_GAP}").select(
        F.col("o_orderkey").cast("long").alias("update_id"), "o_orderstatus", "o_custkey")
    book, checkpoint = _ledger(spark)
    ledger.finish(ledger.run_updates(_arriving(rows, F.pmod("o_custkey", F.lit(4)), 4), book, {"source": "orders"}, checkpoint))
    done = ledger.released_updates(book, ledger.schema_of(rows)).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("updates"), F.sum("update_id").alias("id_sum"))
    return done.withColumn("next_update", F.lit(book.last()["state"]["next_update"]).cast("long"))


_SHARD = 500


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS after, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS so_far, max(event_id) OVER (PARTITION BY user_id) AS final FROM events),
c AS (SELECT e.user_id, e.event_id AS first, e.so_far - 1 AS n0, e.final, f.event_id AS last, f.after, f.so_far AS n1 FROM e ASOF LEFT JOIN e f ON e.user_id = f.user_id AND e.event_id + {_SHARD - 1} <= f.event_id),
r AS (SELECT user_id, 0 AS shard, min(event_id) AS first FROM events GROUP BY 1 UNION ALL SELECT r.user_id, shard + 1, c.after FROM r JOIN c ON c.user_id = r.user_id AND c.first = r.first WHERE c.after IS NOT NULL),
t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT r.user_id AS run, r.shard::BIGINT AS shard, r.first AS first_step, coalesce(c.last, c.final) AS last_step, (coalesce(c.n1, t.n) - c.n0)::BIGINT AS records, c.last IS NOT NULL AS closed
FROM r JOIN c ON c.user_id = r.user_id AND c.first = r.first JOIN t ON t.user_id = r.user_id""")
def stream_shard_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of each user's steps in three batches: gaps in the steps move the boundaries."""
    rows = roles.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").cast("long").alias("step"))
    width = rows.agg(F.max("step")).first()[0] // 3 + 1
    emitted = streams.shard_roll(_arriving(rows, F.expr(f"step div {width}"), 3), _SHARD)
    book, checkpoint = _ledger(spark)
    ledger.finish(ledger.into(emitted, book, checkpoint))
    return streams.rolled(book.read("rows", ledger.schema_of(emitted)))
