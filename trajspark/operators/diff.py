"""Run-to-run comparison: full outer diffs, positional diffs, tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from . import order as places


def _sides(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    l = left.select(*keys, F.struct(*fields).alias("l"))
    r = right.select(*keys, F.struct(*fields).alias("r"))
    return l.join(r, keys, "full_outer")


def compare(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., status, fields): 'missing' on the right, 'extra' there, or 'changed' with the names of the fields."""
    both = _sides(left, right, keys, fields)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), F.lit(f)) for f in fields]))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.size(changed) > 0, "changed")
    listed = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), changed).otherwise(F.array().cast("array<string>"))
    return both.select(*keys, status.alias("status"), listed.alias("fields")).filter("status is not null")


#: What the inventories of an optimizer's state have for each parameter, and what a bundle compares beside that.
STATE_FIELDS = (
    "optimizer_state_present", "optimizer_state_keys", "optimizer_step", "exp_avg_shape", "exp_avg_dtype", "exp_avg_checksum",
    "exp_avg_sq_shape", "exp_avg_sq_dtype", "exp_avg_sq_checksum",
)
BUNDLE_FIELDS = ("optimizer_group_index", "position_in_group", *STATE_FIELDS, "step_checksum")
#: What a microbatch's signature keeps when attempts are compared, and its place in the two orders of streams.
SIGNATURE_FIELDS = ("optimizer_step", "rank", "microbatch_id", "gradient_accumulation_index")


def inventory_report(before: DataFrame, after: DataFrame, key: str = "parameter_name", fields: tuple[str, ...] = STATE_FIELDS, examples: int = 20) -> DataFrame:
    """One row: parameters that only one side has, those whose state differs, whether all is equal, and the first examples (a report of ``examples`` names with their fields)."""
    found = compare(before, after, [key], list(fields))
    of = lambda s: F.col("status") == s
    one = found.agg(
        F.count_if(of("missing")).alias("missing"), F.count_if(of("extra")).alias("extra"), F.count_if(of("changed")).alias("state_mismatch_count"), (F.count(F.lit(1)) == 0).alias("equal"))
    first = found.filter(of("changed")).orderBy(key).limit(examples)
    listed = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), "fields"))), lambda x: F.concat(x["k"], F.lit(":"), F.array_join(x["fields"], "+"))), ",").alias("examples"))
    return one.crossJoin(listed)  # one row each


def normalised_signatures(rows: DataFrame, content: list[str]) -> DataFrame:
    """Signatures as runs are compared by: only their place and content; attempts, paths, times and whatever else is recorded are left out."""
    return rows.select(*[F.col(f).cast("long").alias(f) for f in SIGNATURE_FIELDS], *content)


def compare_signatures(left: DataFrame, right: DataFrame, content: list[str]) -> DataFrame:
    """(rank, place, status) where the normalised streams of a rank, in order of microbatch and step, differ at a place."""
    own = list(SIGNATURE_FIELDS) + content
    sides = [normalised_signatures(s, content).withColumn("__s", F.struct(*own)) for s in (left, right)]
    return compare_positions(*sides, ["rank"], ["microbatch_id", "optimizer_step"], "__s").select("rank", "place", "status")


def summary(differences: DataFrame) -> DataFrame:
    return differences.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "extra", "changed")])


def first_difference(differences: DataFrame, keys: list[str]) -> DataFrame:
    return differences.agg(F.min(F.struct(*keys, "status")).alias("first")).select("first.*")


def compare_positions(left: DataFrame, right: DataFrame, partition: list[str], order: list[str], field: str) -> DataFrame:
    """Streams compared place by place within each partition; the longer one's surplus shows as missing or extra."""
    l, r = (places.numbered_within(side, partition, order, "place") for side in (left, right))
    return compare(l, r, [*partition, "place"], [field])


def metric_differences(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """For each metric the greatest absolute difference over common keys, and the keys only one side has."""
    both = _sides(left, right, [key], metrics)
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"),
        *[F.max(F.abs(F.col(f"l.{m}") - F.col(f"r.{m}"))).alias(f"max_{m}") for m in metrics],
    )


def greatest_change(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Greatest absolute difference, the key that has it with its relative difference, and the first key that differs."""
    both = _sides(left, right, [key], [value]).filter("l is not null and r is not null")
    apart = F.abs(F.col(f"l.{value}") - F.col(f"r.{value}"))
    relative = apart / F.greatest(F.abs(F.col(f"l.{value}")), F.lit(1e-12))
    rows = both.select(key, apart.alias("d"), relative.alias("rel"))
    return rows.agg(
        F.max("d").alias("max_abs"), F.max_by(F.struct(key, "rel"), F.struct(F.col("d"), F.col(key))).alias("at"), F.min(F.when(F.col("d") > 0, F.col(key))).alias("first_differing")
    ).select("max_abs", F.col(f"at.{key}").alias("max_key"), F.col("at.rel").alias("max_key_relative"), "first_differing")


def missing_and_extra(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference both ways, with the side that has the key."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(a.join(e, keys, "left_anti").withColumn("status", F.lit("extra")))


def set_equality(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether both sides have the same keys, and how many each side lacks."""
    counts = missing_and_extra(left, right, keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "extra")])
    return counts.select(((F.col("missing") == 0) & (F.col("extra") == 0)).alias("same"), "missing", "extra")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; later lines win."""
    others = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def assertions(checks: DataFrame) -> DataFrame:
    """(name, expected, actual) with ``passed``: equal within 1e-12 relative or 1e-9 absolute, nulls equal."""
    near: Column = scalars.is_close("expected", "actual", 1e-12, 1e-9)
    return checks.withColumn("passed", F.coalesce(near, F.col("expected").isNull() & F.col("actual").isNull()))


def reusable(current: DataFrame, recorded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose recorded artifact can be reused: every field the same. The rest is to be computed anew."""
    both = current.select(key, F.struct(*fields).alias("l")).join(recorded.select(key, F.struct(*fields).alias("r")), key, "left")
    return both.select(key, F.coalesce(F.col("l").eqNullSafe(F.col("r")) & F.col("r").isNotNull(), F.lit(False)).alias("reuse"))
