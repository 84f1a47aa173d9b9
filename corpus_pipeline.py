"""A corpus-cleaning pipeline: five stages over ``documents``, each one operator at work.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import decontaminate, packing, simhash, substring_dedup, toxicity
from trajspark.llm.common import materialize, table
from trajspark.llm.queries import tokenizer_file
from trajspark.session import share_code

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_code(spark)
        return f(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("predicted = 0").select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in five-word shingles one row stays: that with the smallest doc_id (nulls last), then text hash."""
    classes = simhash.near_duplicate_classes(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = classes.groupBy("root").agg(F.min(key).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__hash"))
    rows = docs.withColumn("__text", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    # what is left of a class are rows of one doc_id and one text: the least of them
    return rows.groupBy("doc_id", "__text").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; a document that loses all its words goes with them."""
    cleaned = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cleaned.filter("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", size).select(*docs.columns)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, told apart by doc_id and text: a clean row stays whatever other rows of its id, or without one, hold."""
    rows = docs.withColumn("__text", F.xxhash64("text"))
    leaks = decontaminate.find_leaks(rows, table(spark, sf_dir, "benchmark"), keep=("__text",))
    hit = leaks.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).distinct()
    same = rows["doc_id"].eqNullSafe(F.col("__id")) & (rows["__text"] == F.col("__hash"))
    return rows.join(hit, same, "left_anti").select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express none of the first two stages; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared scratch folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
