"""Weighted rendezvous sharding of stable record keys (DataFrame functions only).

Every (key, shard) pair gets a pseudo-random draw that depends on the two
alone; the shard with the least ``-ln(u) / weight`` takes the key.  Adding a
shard adds one draw for each key and leaves the others as they were, so keys
move only into the new shard, in proportion to its weight.

Draws: one MD5 for each key gives two residues a, b modulo the prime
2^31 - 1.  A shard's draw is ``((a + c * shard)^5 + b)^5`` modulo that prime;
x -> x^5 is a permutation there, because 5 does not divide 2^31 - 2.

Defined results: a null key is a key like any other (all such rows share a
shard); a null text counts 0 bytes and has the CRC of the empty string;
repeated rows each get a slot; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import order
from .common import materialize

PRIME = 2147483647
STEP = 40503793
ROW_OVERHEAD = 16


def _fifth(xs: Column) -> Column:
    """x^5 modulo the prime for each x of an array; each product is evaluated once."""
    squares = F.transform(xs, lambda x: F.struct(x.alias("x"), (x * x % PRIME).alias("q")))
    fourths = F.transform(squares, lambda s: F.struct(s["x"].alias("x"), (s["q"] * s["q"] % PRIME).alias("q")))
    return F.transform(fourths, lambda s: s["q"] * s["x"] % PRIME)


def _residue(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 12), 16, 10).cast("long") % F.lit(PRIME)


def draws(key: Column, shards: int) -> Column:
    """One draw in [0, prime) for each of the shards 0 to ``shards - 1``."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    seeds = F.array(F.struct(_residue(digest, 1).alias("a"), _residue(digest, 13).alias("b")))
    numbers = F.lit([i * STEP % PRIME for i in range(shards)]).cast("array<bigint>")

    def mixed(seed: Column) -> Column:
        first = _fifth(F.transform(numbers, lambda i: (seed["a"] + i) % PRIME))
        return _fifth(F.transform(first, lambda x: (x + seed["b"]) % PRIME))

    # the one-element array makes the digest a lambda argument: it is computed once a row
    return F.element_at(F.transform(seeds, mixed), 1)


def choose(drawn: Column, weights: Sequence[float]) -> Column:
    """The shard of the least ``-ln(u) / weight``; a shard of weight 0 takes nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    known = F.lit([float(w) for w in weights])
    costs = F.zip_with(
        F.slice(drawn, 1, len(weights)), known,
        lambda x, w: F.when(w > 0, -F.log((x + 1) / F.lit(float(PRIME + 1))) / w),
    )
    numbered = F.transform(costs, lambda c, i: F.struct(c.isNull().alias("off"), c.alias("cost"), i.alias("shard")))
    return F.array_min(numbered)["shard"]


def rendezvous(key: Column, *weightings: Sequence[float]) -> Column:
    """Array of the shards that take ``key`` under the weightings, from one set of draws."""
    most = max(map(len, weightings))
    return F.element_at(
        F.transform(F.array(draws(key, most)), lambda d: F.array(*[choose(d, w) for w in weightings])), 1
    )


def shard_documents(
    docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float] | None = None,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Shard and slot of every row, and its shard after growing.

    The slot is the row's gapless place in its shard (ordered by key, then
    CRC and size), found by ranges of the whole order: no shard is gathered in
    one task, and the texts themselves are never shuffled.
    """
    grown = list(grown_weights) if grown_weights is not None else [*weights, sum(weights) / len(weights)]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights, grown).alias("__both"),
    ).select(
        "doc_id", "size", "text_crc32", "law", F.col("__both")[0].alias("shard"), F.col("__both")[1].alias("grown_shard")
    )
    # written once: only ids, sizes and CRCs are dealt out, and no text is read again
    rows = materialize(rows, "shards")
    ranked = order.numbered_within(rows, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "slot")
    ranked = ranked.withColumn("slot", F.col("slot") - 1)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
