"""Places, running sums and quantiles over whole tables, and plans without a task for all rows."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajspark.operators import datasets, order, packing, selectors


def values(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice([None, rng.randrange(50), rng.randrange(10**9)]), rng.choice("abc")) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 700])
def test_places_follow_the_order(spark, n):
    df = spark.createDataFrame(values(n), "k long, v long, g string").repartition(7)
    found = order.numbered(df, [F.col("v").desc_nulls_last(), "k"], "place").orderBy("place").collect()
    expected = sorted(values(n), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["k"], r["place"]) for r in found] == [(r[0], i + 1) for i, r in enumerate(expected)]
    inside = order.numbered_within(df, ["g"], ["k"], "place").collect()
    for g in "abc":
        own = sorted((r["place"], r["k"]) for r in inside if r["g"] == g)
        assert [p for p, _ in own] == list(range(1, len(own) + 1)) and [k for _, k in own] == sorted(k for _, k in own)


def test_running_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(order, "PER_BUCKET", 7)
    rows = [(i, (i * 37) % 11) for i in range(200)]
    found = {r["p"]: r["s"] for r in order.running_sum(spark.createDataFrame(rows, "p long, v long"), "p", "v", "s").collect()}
    assert all(found[p] == sum(v for q, v in rows if q < p) for p, _ in rows)


def test_quantiles_are_interpolated(spark):
    x = [random.Random(4).random() for _ in range(333)]
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    row = order.quantiles(spark.createDataFrame([(v,) for v in x] + [(None,)], "v double"), "v", shares).first()
    assert [row[k] for k in shares] == pytest.approx([np.quantile(x, q) for q in shares.values()])
    assert order.quantiles(spark.createDataFrame([], "v double"), "v", {"a": 0.5}, 0.0).first()["a"] == 0.0


def test_global_indexes_with_uneven_children(spark):
    lengths = [0, 1, 1, 500, 0, 3, 1, 1]
    children = spark.createDataFrame(list(enumerate(lengths)), "child long, length long")
    indexes = spark.createDataFrame([(i,) for i in range(-2, sum(lengths) + 2)], "index long")
    found = sorted(tuple(r) for r in datasets.locate(indexes, children).collect())
    flat = [(c, k) for c, n in enumerate(lengths) for k in range(n)]
    assert found == [(i, *flat[i]) for i in range(len(flat))]


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans_have_no_nested_loop_over_rows(spark):
    items = spark.range(3000).select(F.col("id").alias("index"))
    frames = {
        "locate": datasets.locate(items, spark.range(40).select(F.col("id").alias("child"), F.lit(75).cast("long").alias("length"))),
        "occurrences": packing.occurrences(items, packing.updates(spark, 0, 10), 32, 3000, 1),
        "shard": packing.shard(items, ["index"], 4), "fraction": packing.sample_fraction(items, "index", 0.1, 1, "x"),
        "rank": selectors.ranked(spark.range(50).select(F.col("id").alias("episode")), [F.desc("episode")]),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
        # what one task sees has a row for each partition or bucket: a partial count or sum stands below it
        for part in text.split("Exchange SinglePartition")[:-1]:
            assert "HashAggregate" in part, name
