"""Scalar column functions: keys, hashes, normalisation, schedules, path and name rules."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

#: Fixed values of the file and number formats.
EPSILON = 1e-6
CLIP = 1.5
SEED_MODULUS = (1 << 63) - 1
ACTION_BLOCK = 16
TOKENS_PER_FRAME = 424
TOKEN_MULTIPLE = 128


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def canonical_id(*parts: str | Column) -> Column:
    """Tab-joined key of an action target; for output and hashing, joins keep the parts."""
    return F.concat_ws("\t", *[c(p).cast("string") for p in parts])


def canonical_json(**fields: str | Column) -> Column:
    """Compact JSON with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[c(fields[k]).alias(k) for k in sorted(fields)]))


def stable_hash(**fields: str | Column) -> Column:
    """SHA-256 of the canonical JSON; byte-stable for integer, string and boolean fields."""
    return F.sha2(canonical_json(**fields), 256)


def _listed(value: object) -> object:
    """A value as JSON has it: structs and maps with string keys, lists; what JSON lacks is its text."""
    if isinstance(value, dict):
        return {str(k): _listed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_listed(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


@F.arrow_udf(StringType())
def payload_json(payload: pa.Array) -> pa.Array:
    """The canonical JSON of a struct (an Arrow function), with its nulls, nested lists, structs and maps.

    Keys are sorted at every depth, separators are compact, other letters than
    ASCII are escaped, and floating-point numbers have their shortest form;
    dates, decimals and binary values are their text.  A null struct is ``null``.
    """
    rows = payload.to_pylist(maps_as_pydicts="strict")
    return pa.array([json.dumps(_listed(r), sort_keys=True, separators=(",", ":")) for r in rows], pa.string())


def payload_hash(payload: str | Column) -> Column:
    """SHA-256 of :func:`payload_json`, where fields are floating-point, nested or null; else :func:`stable_hash` does without Python."""
    return F.sha2(payload_json(c(payload)).cast("binary"), 256)


def occurrence_id(run: str | Column, rank: str | Column, step: str | Column, microbatch: str | Column, slot: str | Column) -> Column:
    return stable_hash(logical_run_id=run, rank=rank, optimizer_step=step, microbatch_id=microbatch, sample_slot=slot)


def support_digest(ids: Column) -> Column:
    """Order-independent SHA-256 of a set of ids (an aggregate): sorted, each followed by a line end."""
    listed = F.array_sort(F.collect_set(ids))
    return F.sha2(F.when(F.size(listed) > 0, F.concat(F.array_join(listed, "\n"), F.lit("\n"))).otherwise(""), 256)


def support_fingerprint(ids: Column) -> Column:
    """Commutative alternative for sets too large for one string: XOR and count of 64-bit hashes."""
    return F.concat_ws(":", F.count(ids), F.hex(F.bit_xor(F.xxhash64(ids))))


def round_up(x: str | Column, multiple: int) -> Column:
    return F.floor((c(x) + multiple - 1) / F.lit(multiple)).cast("long") * multiple


def episode_tokens(frames: str | Column) -> Column:
    return round_up(c(frames) * TOKENS_PER_FRAME, TOKEN_MULTIPLE)


def grid_tokens(frames, height, width, patch_h: int, patch_w: int, actions) -> Column:
    visual = c(frames) * F.floor(c(height) / F.lit(patch_h)) * F.floor(c(width) / F.lit(patch_w))
    return round_up((visual + c(frames) * c(actions)) * 2, TOKEN_MULTIPLE)


def quantile_normalise(x, low, high, fixed: Column | None = None, mask: Column | None = None) -> Column:
    """Quantile range to [-1, 1], clipped at 1.5; fixed channels are exactly 0."""
    out = (c(x) - c(low)) / (c(high) - c(low) + EPSILON) * 2 - 1
    out = F.greatest(F.least(out, F.lit(CLIP)), F.lit(-CLIP))
    if fixed is not None:
        out = F.when(fixed, F.lit(0.0)).otherwise(out)
    return out if mask is None else out * mask.cast("double")


def quantile_denormalise(x, low, high) -> Column:
    return (c(x) + 1) / 2 * (c(high) - c(low) + EPSILON) + c(low)


def standardise(x, mean, std) -> Column:
    return (c(x) - c(mean)) / (c(std) + EPSILON)


def unstandardise(x, mean, std) -> Column:
    return c(x) * (c(std) + EPSILON) + c(mean)


def gripper_sign(x) -> Column:
    return F.signum(1 - 2 * c(x))


def parameter_name(name: str | Column) -> Column:
    """Strip wrapper prefixes, however often repeated, and the wrapper's infix."""
    stripped = F.regexp_replace(c(name), r"^(?:(?:module|_fsdp_wrapped_module)\.)+", "")
    return F.replace(stripped, F.lit("._fsdp_wrapped_module."), F.lit("."))


def selector_of(name: str | Column) -> Column:
    return F.regexp_extract(c(name), r"^(.*)_b(\d+)$", 1)


def budget_of(name: str | Column) -> Column:
    return F.try_divide(F.expr("try_cast(null as double)") if name is None else F.regexp_extract(c(name), r"^(.*)_b(\d+)$", 2).try_cast("double"), F.lit(100.0))


def episode_path(episode: str | Column, chunk_size: int) -> Column:
    chunk = F.floor(c(episode) / F.lit(chunk_size)).cast("int")
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk, c(episode))


def sample_key(*parts: str | Column) -> Column:
    return F.concat_ws("|", *[c(p).cast("string") for p in parts])


def is_safe_relative_path(path: str | Column) -> Column:
    p = c(path)
    segments = F.split(p, "/")
    odd = F.exists(segments, lambda s: s.isin("..", ".", ""))
    return p.isNotNull() & (p != "") & ~p.contains("\\") & ~odd


def is_sha256(text: str | Column) -> Column:
    return F.coalesce(F.rlike(c(text), F.lit("^[0-9a-fA-F]{64}$")), F.lit(False))


def is_integer_count(x: str | Column) -> Column:
    """A finite, integral, non-negative number; null is none."""
    v = c(x).try_cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 0) & (v == F.floor(v)), F.lit(False))


def is_finite(x: str | Column) -> Column:
    return F.coalesce(~F.isnan(c(x)) & (F.abs(c(x)) < float("inf")), F.lit(False))


def is_close(a, b, rel: float = 1e-9, absolute: float = 1e-9) -> Column:
    a, b = c(a), c(b)
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def span_hours(first, last) -> Column:
    return (F.unix_timestamp(c(last)) - F.unix_timestamp(c(first))) / 3600.0


def strict_flag(x: str | Column) -> Column:
    """'0' or '1' to boolean; anything else is an error."""
    return F.when(c(x) == "1", True).when(c(x) == "0", False).otherwise(F.raise_error(F.lit("flag must be 0 or 1")).cast("boolean"))


def name_guess(name: str | Column, rules: dict[str, str], default: str) -> Column:
    """First rule whose key occurs in the lower-cased name."""
    out = None
    for part, value in rules.items():
        test = F.lower(c(name)).contains(part)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)


def flatten_map(nested: str | Column) -> Column:
    """{a: {b: v}} to {'a.b': v}."""
    entries = F.flatten(F.transform(
        F.map_entries(c(nested)),
        lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value"))),
    ))
    return F.map_from_entries(entries)


def array_profile(x: str | Column) -> Column:
    """Size, finiteness, least, greatest and mean of an array."""
    a = F.transform(c(x), lambda v: v.cast("double"))
    total = F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return F.struct(
        F.size(a).alias("size"), F.forall(a, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))).alias("finite"),
        F.array_min(a).alias("least"), F.array_max(a).alias("most"), F.try_divide(total, F.size(a).cast("double")).alias("mean"),
    )


def ramp(step: str | Column, warm_up: int) -> Column:
    return F.least(F.lit(1.0), c(step) / F.lit(float(warm_up)))


def shifted_sigma(sigma: str | Column, shift: float) -> Column:
    return shift * c(sigma) / (1 + (shift - 1) * c(sigma))


def shift_for_length(length: str | Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Line through two (length, shift) points."""
    slope = (high[1] - low[1]) / (high[0] - low[0])
    return c(length) * slope + (low[1] - slope * low[0])


def schedule(spark: SparkSession, n: int, shift: float) -> DataFrame:
    """(step, sigma, timestep, weight): shifted sigmas, bell-shaped weights with least 0 and mean 1."""
    steps = spark.range(n).select(F.col("id").alias("step"), (1.0 - F.col("id") / F.lit(float(n))).alias("base"))
    rows = steps.withColumn("sigma", shifted_sigma("base", shift)).withColumn("timestep", F.col("sigma") * n)
    bell = F.exp(-2.0 * F.pow((F.col("timestep") - n / 2) / F.lit(float(n)), F.lit(2.0)))
    rows = rows.withColumn("bell", bell)
    ends = rows.agg(F.min("bell").alias("least"), F.avg("bell").alias("mean"))
    return rows.crossJoin(F.broadcast(ends)).select(  # one row on the right
        "step", "sigma", "timestep", ((F.col("bell") - F.col("least")) / (F.col("mean") - F.col("least"))).alias("weight"),
    )


def timestep_id(u: str | Column, n: int, low: int = 0, high: int | None = None) -> Column:
    last = n - 1 if high is None else min(high, n) - 1
    return F.least(F.greatest(F.floor(c(u) * n).cast("int"), F.lit(low)), F.lit(last))


def half_even(x: str | Column) -> Column:
    """Round to an integer, halves to even."""
    return F.bround(c(x), 0).cast("long")


@F.pandas_udf(LongType())
def _seed(seed: pd.Series, uid: pd.Series, tag: pd.Series) -> pd.Series:
    def one(s, u, t):
        digest = hashlib.blake2b(f"{int(s)}:{int(u)}:{t}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "little") % SEED_MODULUS

    return pd.Series([one(*x) for x in zip(seed, uid, tag, strict=True)], dtype="int64")


def stateless_seed(seed: int, uid: str | Column, tag: str) -> Column:
    """BLAKE2b seed of (seed, uid, tag); a vectorised Python function, as Spark has no BLAKE2."""
    return _seed(F.lit(seed).cast("long"), c(uid).cast("long"), F.lit(tag))


def stateless_uniform(seed: int, uid: str | Column, tag: str) -> Column:
    return stateless_seed(seed, uid, tag).cast(DoubleType()) / F.lit(float(SEED_MODULUS))


def scatter(values: str | Column, mapping: dict[int, int], size: int) -> Column:
    """Array of ``size`` with values[k] at mapping[k], 0.0 elsewhere."""
    back = {to: at for at, to in mapping.items()}
    return F.array(*[F.get(c(values), F.lit(back[i])).cast("double") if i in back else F.lit(0.0) for i in range(size)])


def gather(values: str | Column, places: list[int]) -> Column:
    """values[p] for each place; 0.0 for a place outside the array."""
    return F.transform(F.array(*map(F.lit, places)), lambda p: F.coalesce(F.get(c(values), p).cast("double"), F.lit(0.0)))


def interval_ids(count: Column, start: Column | None = None, step: int = 1) -> Column:
    """start, start + step, ... of ``count`` items; empty for a count of zero or less."""
    first = F.lit(0).cast("long") if start is None else start.cast("long")
    return F.when(count > 0, F.sequence(first, first + (count.cast("long") - 1) * step, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
