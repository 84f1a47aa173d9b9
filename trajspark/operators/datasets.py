"""Dataset-level operators: splits, lookups, audits, fingerprints, examples, layout statistics."""

from __future__ import annotations

import hashlib
import os
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .. import scratch
from ..functions import scalars, vectors
from . import order, quality


def split_range(text: str) -> tuple[int, int]:
    """'a:b' as the half-open range [a, b)."""
    found = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", text)
    if not found or int(found[1]) >= int(found[2]):
        raise ValueError(f"not a split range: {text!r}")
    return int(found[1]), int(found[2])


def in_split(episodes: DataFrame, split: str, key: str = "episode_index") -> DataFrame:
    low, high = split_range(split)
    return episodes.filter((F.col(key) >= low) & (F.col(key) < high))


def missing_from_split(episodes: DataFrame, split: str, key: str = "episode_index") -> DataFrame:
    """Ids of the range that the table lacks."""
    low, high = split_range(split)
    wanted = episodes.sparkSession.range(low, high).withColumnRenamed("id", key)
    return wanted.join(episodes.select(key).distinct(), key, "left_anti")


def first_tasks(episodes: DataFrame, tasks: DataFrame, n: int) -> DataFrame:
    """Only the first n tasks keep their configs; other episodes stay, with an empty list, so indexes don't move."""
    chosen = tasks.orderBy("task_index").limit(n).select("task", F.lit(True).alias("__kept"))
    rows = episodes.withColumn("__task", F.element_at("tasks", 1)).join(F.broadcast(chosen), F.col("__task") == F.col("task"), "left")  # n rows
    empty = F.filter("action_config", lambda _: F.lit(False))
    return rows.withColumn("action_config", F.when(F.col("__kept"), F.col("action_config")).otherwise(empty)).drop("__task", "__kept", "task")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Dictionary lookup; a key that the table lacks is an error when its row is computed."""
    t = table.select(F.col(key).alias("__k"), F.col(value))
    joined = df.join(t, F.col(key) == F.col("__k"), "left")
    failed = F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return joined.withColumn(value, F.when(F.col("__k").isNull(), failed.cast(dict(table.dtypes)[value])).otherwise(F.col(value))).drop("__k")


def lookup_or_blank(df: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left lookup whose misses are empty strings."""
    return df.join(table.select(*keys, *values), keys, "left").withColumns({v: F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values})


def locate(indexes: DataFrame, children: DataFrame) -> DataFrame:
    """Global index to (child, local index): children have (child, length) and follow one another by child.

    A child is filed under the cells of the index range that it reaches into,
    cells as wide as the mean child; an index meets the children of its cell.
    """
    known = order.numbered(children.select("child", "length").filter("length > 0"), ["child"], "__place")
    offsets = scratch.materialize(order.running_sum(known, "__place", "length", "__from").drop("__place"), "offsets")
    size = offsets.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).first()
    width = max(1, size["total"] // max(1, size["n"]))
    cells = offsets.withColumn("__cell", F.explode(F.expr(f"sequence(__from div {width}, (__from + length - 1) div {width})")))
    joined = indexes.withColumn("__cell", F.expr(f"`index` div {width}")).join(cells, "__cell")
    inside = (F.col("index") >= F.col("__from")) & (F.col("index") < F.col("__from") + F.col("length"))
    return joined.filter(inside).select("index", "child", (F.col("index") - F.col("__from")).alias("local"))


def with_parent(segments: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Segments with their parents' attributes, and violations where the tasks differ."""
    p = parents.select(key, *[F.col(c).alias(f"parent_{c}") for c in parents.columns if c != key])
    joined = segments.join(p, key)
    return joined, quality.violations(joined, key, {"task_differs": F.col("task") != F.col("parent_task")})


def segment_totals(segments: DataFrame, parent: str) -> DataFrame:
    """Parents, split parents, segments, frames and tokens."""
    by = segments.groupBy(parent).agg(F.count(F.lit(1)).alias("n"), F.sum("frame_count").alias("f"), F.sum("token_count").alias("t"))
    return by.agg(
        F.count(F.lit(1)).alias("parent_episodes"), F.count_if(F.col("n") > 1).alias("split_episodes"), F.sum("n").alias("segments"),
        F.sum("f").alias("virtual_segment_frames"), F.sum("t").alias("total_tokens"),
    )


def audit(episodes: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """A row for each data set: episodes, frames, segments, files, and a status."""
    e = episodes.groupBy(key).agg(F.count(F.lit(1)).alias("episodes"), F.sum("length").alias("frames"), F.sum(F.size("action_config")).alias("segments"))
    f = files.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    joined = e.join(f, key, "left").fillna(0, ["files"])
    status = (F.when(F.col("files") == 0, "no_files").when(F.col("segments") == 0, "no_segments")
              .when(F.col("files") < F.col("episodes"), "incomplete").otherwise("ready"))
    return joined.withColumn("status", status)


def presence(expected: DataFrame, actual: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Present and missing keys by group (camera), with a status."""
    found = expected.select(*keys).distinct().join(actual.select(*keys, F.lit(True).alias("__in")).distinct(), keys, "left")
    counted = found.groupBy(group).agg(F.count_if(F.col("__in").isNotNull()).alias("present"), F.count_if(F.col("__in").isNull()).alias("missing"))
    status = F.when(F.col("present") == 0, "absent").when(F.col("missing") > 0, "partial").otherwise("complete")
    return counted.withColumn("status", status)


def trace_summary(steps: DataFrame, vector: str, value: str) -> DataFrame:
    """Norm quantiles of action vectors, and the values' histogram as sorted 'value:count' parts."""
    norms = steps.select(vectors.norm(vector).alias("n")).agg(
        F.percentile("n", F.lit(0.5)).alias("norm_p50"), F.percentile("n", F.lit(0.95)).alias("norm_p95"), F.max("n").alias("norm_max"))
    counts = steps.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    histogram = counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(value).cast("string"), F.col("c").cast("string")))), ",").alias("histogram"))
    return norms.crossJoin(histogram)  # one row each


def first_and_last(rows: DataFrame, step: str, value: str) -> DataFrame:
    return rows.agg(F.min(value).alias("least"), F.max(value).alias("most"), F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"))


def optional_extremes(rows: DataFrame, values: list[str]) -> DataFrame:
    """Least and greatest number of optional text columns; what is no number counts as absent."""
    numbers = {v: F.expr(f"try_cast(`{v}` as double)") for v in values}
    return rows.agg(*[x for v, n in numbers.items() for x in (F.min(n).alias(f"{v}_least"), F.max(n).alias(f"{v}_most"))])


def displacement(left: DataFrame, right: DataFrame, key: str, target: str) -> DataFrame:
    """Sum and maximum of planar distances between two layouts, and the target's own."""
    both = left.select(key, F.col("x").alias("x0"), F.col("y").alias("y0")).join(right.select(key, F.col("x").alias("x1"), F.col("y").alias("y1")), key)
    d = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    return both.withColumn("d", d).agg(F.sum("d").alias("total"), F.max("d").alias("most"), F.max(F.when(F.col(key) == target, F.col("d"))).alias("of_target"))


def examples(rows: DataFrame, key: str, kinds: dict[str, tuple[Column, Column]], first: int, most: int) -> DataFrame:
    """The first row of each kind (condition, order), then the first rows by key, each key once: a report of at most ``most`` rows."""
    picked = [rows.filter(c).orderBy(o, key).limit(1).withColumn("kind", F.lit(k)).withColumn("__p", F.lit(n)) for n, (k, (c, o)) in enumerate(kinds.items())]
    picked.append(rows.orderBy(key).limit(first).withColumn("kind", F.lit("first")).withColumn("__p", F.lit(len(kinds))))
    both = reduce(DataFrame.unionByName, picked)
    once = both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__p"))).filter("__r = 1")
    return once.orderBy("__p", key).limit(most).drop("__r", "__p")


@F.pandas_udf(StringType())
def _segment_digest(actions: pd.Series, masks: pd.Series) -> pd.Series:
    def one(rows, mask):
        body = np.asarray([np.asarray(r, np.float32) for r in rows], "<f4").tobytes()
        flags = np.asarray([np.asarray(m, np.uint8) for m in mask], np.uint8).tobytes()
        return hashlib.sha256(body + flags).hexdigest()

    return pd.Series([one(a, m) for a, m in zip(actions, masks, strict=True)])


def segment_digest(actions: Column, masks: Column) -> Column:
    """SHA-256 of the float32 bytes of a segment's actions, then of its mask bytes: byte packing, so a vectorised Python function."""
    return _segment_digest(actions, masks)


def manifest_fingerprint(rows: DataFrame, by: str) -> DataFrame:
    """One digest of an ordered manifest (a bounded table)."""
    others = [c for c in rows.columns if c != by]
    listed = F.array_sort(F.collect_list(F.struct(by, F.to_json(F.struct(*sorted([by, *others]))).alias("j"))))
    return rows.agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["j"]), "\n"), 256).alias("fingerprint"))


def state_digest(rows: DataFrame, group: str) -> DataFrame:
    """A digest of parameter states in their order (group, position)."""
    listed = F.array_sort(F.collect_list(F.struct("position_in_group", F.to_json(F.struct("parameter_name", "parameter_shape", "parameter_dtype", "step_checksum")).alias("j"))))
    return rows.groupBy(group).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["j"]), "\n"), 256).alias("digest"))


def collection_audit(reports: DataFrame) -> DataFrame:
    """Errors of subset reports (subset, key, rule) with the subset in front, and schema agreement left to :func:`quality.agreement`."""
    return reports.select(F.concat_ws(": ", "subset", "key").alias("key"), "rule")


def validate_reference(regenerated: DataFrame, stored: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per-field equality of a regenerated record with the one stored under its keys, which must be exactly one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    s = stored.withColumn("__n", n).select(*keys, "__n", F.struct(*fields).alias("__s"))
    joined = regenerated.join(s, keys, "left")
    equal = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(f).eqNullSafe(F.col(f"__s.{f}")) for f in fields]))
    return joined.select(*keys, F.coalesce(F.col("__n"), F.lit(0)).alias("matches"), equal.alias("equal"))


def check_output_paths(root: str, protected: list[str], outputs: list[str]) -> None:
    """Outputs must be distinct direct children of the root, none protected, none inside another."""
    real = [os.path.abspath(o) for o in outputs]
    if len(set(real)) != len(real):
        raise ValueError("outputs must be distinct")
    for o in real:
        if os.path.dirname(o) != os.path.abspath(root):
            raise ValueError(f"{o} is no direct child of {root}")
        for p in map(os.path.abspath, protected):
            if o == p or o.startswith(p + os.sep) or p.startswith(o + os.sep):
                raise ValueError(f"{o} overlaps the protected {p}")


def plan_delta(frames: DataFrame, group: list[str], order: str, a: str, b: str) -> DataFrame:
    """Metrics between two plans' vectors over the frames after the first."""
    later = frames.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy(order))).filter("__r > 1")
    return later.groupBy(*group).agg(
        F.avg(vectors.rmse(a, b)).alias("rmse"), F.avg(vectors.mean_abs(a, b)).alias("mean_abs"), F.max(vectors.max_abs(a, b)).alias("max_abs"), F.avg(vectors.cosine(a, b)).alias("cosine"),
    )


def layout_response(frames: DataFrame, group: list[str], order: str, a: str, b: str) -> DataFrame:
    """Response of later frames to the first frame's difference: gain, direction, retained projection; means and the last."""
    d = frames.withColumn("__d", vectors.minus(b, a))
    d = d.withColumn("__d0", F.first("__d").over(Window.partitionBy(*group).orderBy(order)))
    size0 = vectors.norm("__d0")
    rows = d.withColumns({
        "gain": F.try_divide(vectors.norm("__d"), size0), "direction": vectors.cosine("__d", "__d0"), "retained": F.try_divide(vectors.dot("__d", "__d0"), size0 * size0),
        "__r": F.row_number().over(Window.partitionBy(*group).orderBy(order)),
    }).filter("__r > 1")
    names = ("gain", "direction", "retained")
    return rows.groupBy(*group).agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.max_by(n, order).alias(f"last_{n}") for n in names])


def masked_motion(cells: DataFrame, group: list[str], motion: str, other: str) -> DataFrame:
    """Mean motion inside the mask of cells at or above the 90 % quantile, outside it, and the ratio of another map's."""
    threshold = cells.groupBy(*group).agg(F.percentile(motion, F.lit(0.9)).alias("q90"))
    rows = cells.join(threshold, group)
    inside = F.col(motion) >= F.col("q90")
    mean = lambda c, x: F.avg(F.when(c, F.col(x)))
    return rows.groupBy(*group).agg(
        mean(inside, motion).alias("inside"), mean(~inside, motion).alias("outside"), F.try_divide(mean(inside, other), mean(inside, motion)).alias("preserved")
    )


def episode_rows(rows: DataFrame, spans: DataFrame, key: str, step: str) -> DataFrame:
    """Rows of spans [start, end) of their episodes, by episode and a range condition."""
    s = spans.select(F.col(key).alias("__k"), "start", "end")
    return rows.join(s, (F.col(key) == F.col("__k")) & (F.col(step) >= F.col("start")) & (F.col(step) < F.col("end"))).drop("__k")


def finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.filter(reduce(lambda a, b: a & b, [scalars.is_finite(c) for c in columns]))
