"""Deterministic sampling and token-budget packing of training updates.

An update's plan is inherently sequential, but updates are independent: each
is planned by one vectorised group function, in parallel over updates.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from . import order as places


@dataclass(frozen=True)
class Limits:
    """Shape of an update: ranks, items of a rank, and a pack's caps."""

    ranks: int
    per_rank: int
    max_tokens: int
    max_items: int

    @property
    def per_update(self) -> int:
        return self.ranks * self.per_rank


def draw(seed: int, epoch: str | Column, item: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), scalars.c(epoch).cast("string"), scalars.c(item).cast("string")))


def occurrences(items: DataFrame, updates: DataFrame, per_update: int, n_items: int, seed: int) -> DataFrame:
    """(update_id, sample_uid, epoch, index): an endless stream of epochs, each a permutation of the items.

    Uid u is place ``u mod n`` of epoch ``u div n``; an update that crosses an
    epoch's end goes on in the next one, without padding or repeats.
    """
    uids = updates.select("update_id", F.explode(F.sequence(F.col("update_id") * per_update, (F.col("update_id") + 1) * per_update - 1)).alias("sample_uid"))
    uids = uids.withColumns({"epoch": F.floor(F.col("sample_uid") / F.lit(n_items)).cast("long"), "place": F.pmod("sample_uid", F.lit(n_items)).cast("long")})
    ends = updates.agg(F.min("update_id"), F.max("update_id")).first()
    first, last = ((u or 0) * per_update // n_items if n_items else 0 for u in (ends[0], (ends[1] or 0) + 1))
    epochs = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    drawn = items.select("index", F.explode(epochs).alias("epoch")).join(uids.select("epoch").distinct(), "epoch", "left_semi")
    drawn = drawn.withColumn("draw", draw(seed, "epoch", "index"))
    # each epoch has all items, so a place over all epochs is one in its own
    permuted = places.numbered(drawn, ["epoch", "draw", "index"], "place").withColumn("place", F.pmod(F.col("place") - 1, F.lit(n_items)))
    return uids.join(permuted, ["epoch", "place"]).select("update_id", "sample_uid", "epoch", "index")


def oversized(items: DataFrame, max_tokens: int) -> DataFrame:
    return items.filter(F.col("token_count") > max_tokens)


def assign_ranks(items: list[tuple], ranks: int, per_rank: int) -> list[list[tuple]]:
    """Longest first, each to the rank with the fewest tokens that has room (then fewer items, then lower rank)."""
    heap = [(0, 0, rank) for rank in range(ranks)]
    out: list[list[tuple]] = [[] for _ in range(ranks)]
    for item in sorted(items, key=lambda x: (-x[1], x[0])):
        tokens, count, rank = heapq.heappop(heap)
        out[rank].append(item)
        if count + 1 < per_rank:
            heapq.heappush(heap, (tokens + item[1], count + 1, rank))
    return out


def best_fit(items: list[tuple], limits: Limits) -> list[list[tuple]]:
    """Best-fit decreasing into packs of one shape under the token and item caps."""
    packs: list[dict] = []
    for item in sorted(items, key=lambda x: (-x[1], x[0])):
        fitting = [
            (p["room"], n) for n, p in enumerate(packs)
            if p["shape"] == item[2] and p["room"] >= item[1] and len(p["items"]) < limits.max_items
        ]
        if fitting:
            pack = packs[min(fitting)[1]]
        else:
            pack = {"room": limits.max_tokens, "shape": item[2], "items": []}
            packs.append(pack)
        pack["items"].append(item)
        pack["room"] -= item[1]
    return [p["items"] for p in packs]


def _tokens(pack: list[tuple]) -> int:
    return sum(x[1] for x in pack)


def equalise(packs: list[list[tuple]], wanted: int) -> list[list[tuple]]:
    """Split the fullest pack (the later of equals) by its smallest item until there are enough packs."""
    packs = [list(p) for p in packs]
    while len(packs) < wanted:
        candidates = [n for n, p in enumerate(packs) if len(p) > 1]
        if not candidates:
            raise ValueError("packs cannot be equalised without an empty one")
        fullest = packs[max(candidates, key=lambda n: (_tokens(packs[n]), n))]
        smallest = min(fullest, key=lambda x: (x[1], x[0]))
        fullest.remove(smallest)
        packs.append([smallest])
    return sorted(packs, key=lambda p: (-_tokens(p), p[0][0]))


def plan_update(items: list[tuple], limits: Limits) -> list[tuple[int, int, tuple]]:
    """(rank, micro, item) of one update; items are (uid, tokens, shape)."""
    if len(items) != limits.per_update:
        raise ValueError(f"an update has {limits.per_update} items, not {len(items)}")
    packed = [best_fit(own, limits) for own in assign_ranks(items, limits.ranks, limits.per_rank)]
    micros = max(map(len, packed))
    return [
        (rank, micro, item) for rank, packs in enumerate(packed) for micro, pack in enumerate(equalise(packs, micros)) for item in pack
    ]


def plan(occurring: DataFrame, items: DataFrame, limits: Limits) -> DataFrame:
    """(update_id, rank, micro_idx, sample_uid, index, token_count) for each occurrence."""
    rows = occurring.join(items.select("index", "token_count", F.col("shape_signature").cast("string").alias("shape")), "index")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        places = dict(zip(frame["sample_uid"], frame["index"], strict=True))
        found = plan_update(list(zip(frame["sample_uid"], frame["token_count"], frame["shape"], strict=True)), limits)
        update = frame["update_id"].iloc[0] if len(frame) else 0
        return pd.DataFrame(
            [(update, rank, micro, uid, places[uid], tokens) for rank, micro, (uid, tokens, _) in found],
            columns=["update_id", "rank", "micro_idx", "sample_uid", "index", "token_count"],
        )

    return rows.groupBy("update_id").applyInPandas(
        one, "update_id long, rank int, micro_idx int, sample_uid long, index long, token_count long"
    )


def plan_violations(planned: DataFrame, items: DataFrame, limits: Limits) -> DataFrame:
    """Unequal micro counts, packs over a cap or of mixed shapes, repeated or lost occurrences."""
    shaped = planned.join(items.select("index", F.col("shape_signature").cast("string").alias("shape")), "index")
    packs = shaped.groupBy("update_id", "rank", "micro_idx").agg(
        F.sum("token_count").alias("tokens"), F.count(F.lit(1)).alias("n"), F.count_distinct("shape").alias("shapes")
    )
    pack_rules = packs.select("update_id", F.explode(F.array_compact(F.array(
        F.when(F.col("tokens") > limits.max_tokens, "tokens"), F.when(F.col("n") > limits.max_items, "items"), F.when(F.col("shapes") > 1, "shapes"),
    ))).alias("rule"))
    micros = packs.groupBy("update_id", "rank").agg(F.count(F.lit(1)).alias("m")).groupBy("update_id").agg(F.count_distinct("m").alias("k"))
    totals = planned.groupBy("update_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_uid").alias("d"))
    return pack_rules.unionByName(micros.filter("k > 1").select("update_id", F.lit("micro_counts").alias("rule"))).unionByName(
        totals.filter((F.col("n") != limits.per_update) | (F.col("d") != F.col("n"))).select("update_id", F.lit("occurrences").alias("rule"))
    )


def fill(planned: DataFrame, limits: Limits) -> DataFrame:
    """Token fill of the packs and the ranks' imbalance, by update."""
    ranks = planned.groupBy("update_id", "rank").agg(F.sum("token_count").alias("tokens"), F.count_distinct("micro_idx").alias("packs"))
    return ranks.groupBy("update_id").agg(
        (F.sum("tokens") / (F.sum("packs") * limits.max_tokens)).alias("fill"), (F.max("tokens") / F.avg("tokens")).alias("imbalance"),
    )


def collate(rows: DataFrame, group: list[str], order: str, values: str) -> DataFrame:
    """Variable-length arrays of a pack end to end, with lengths and offsets (one more than arrays)."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__at", F.coalesce(F.sum(F.size(values)).over(before), F.lit(0)).cast("int"))
    own = placed.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, "__at", values))).alias("r"), F.sum(F.size(values)).cast("int").alias("__all"))
    part = lambda name: F.transform("r", lambda x: x[name])
    return own.select(*group, F.flatten(part(values)).alias("values"), F.transform("r", lambda x: F.size(x[values])).alias("lengths"), F.concat(part("__at"), F.array("__all")).alias("offsets"))


def sample_fraction(items: DataFrame, key: str, ratio: float, seed: int, suite: str) -> DataFrame:
    """ceil(n * ratio) items, at least one, by hash rank: a sampling operator of its own."""
    n = items.count()
    take = max(1, -(-int(round(n * ratio * 1_000_000)) // 1_000_000)) if n else 0
    drawn = items.withColumn("__d", F.md5(F.concat_ws(":", F.lit(f"{seed}:{suite}"), F.col(key).cast("string"))))
    return places.numbered(drawn, ["__d", key], "__r").filter(F.col("__r") <= take).drop("__d", "__r")


def shard(items: DataFrame, order: list[str], n: int, k: int | None = None) -> DataFrame:
    """Round robin over the order: place modulo n; only shard k where one is named."""
    rows = places.numbered(items, order, "shard").withColumn("shard", F.pmod(F.col("shard") - 1, F.lit(n)).cast("int"))
    return rows if k is None else rows.filter(F.col("shard") == k)


def suffix(items: DataFrame, cursor: int, cursor_epoch: int, place: str = "place", epoch: str = "epoch") -> DataFrame:
    """What is left after a resume: the cursor's epoch from its place on, and all of later epochs."""
    return items.filter((F.col(epoch) > cursor_epoch) | ((F.col(epoch) == cursor_epoch) & (F.col(place) >= cursor)))


def shared_layout(updates: DataFrame, ranks: int, seed: int) -> DataFrame:
    """(update_id, rank, chunk, window): drawn once for an update, so every rank has the same."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("update_id").cast("string"), F.lit("layout")))
    part = lambda k: F.conv(F.substring(digest, k, 8), 16, 10).cast("long")
    rows = updates.select("update_id", (1 + part(1) % 4).alias("chunk"), (4 + part(9) % 61).alias("window"))
    return rows.select("update_id", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("rank"), "chunk", "window")


class Cursor:
    """Durable position: only the very next update may be committed; states of another configuration are refused."""

    def __init__(self, config: dict, next_update: int = 0):
        self.config, self.next_update = json.loads(json.dumps(config, sort_keys=True)), next_update

    def commit(self, update: int) -> None:
        if update != self.next_update:
            raise ValueError(f"update {update} is not the next one, {self.next_update}")
        self.next_update += 1

    def state(self) -> dict:
        return {"config": self.config, "next_update": self.next_update}

    def load(self, state: dict) -> None:
        if state.get("config") != self.config:
            raise ValueError("the state is of another configuration")
        self.next_update = int(state["next_update"])


def epoch_counters(uid: str, per_batch: int, n_items: int) -> dict[str, Column]:
    """Batches in the epoch, batches so far, samples so far, from the uid alone."""
    u = F.col(uid)
    return {
        "epoch": F.floor(u / F.lit(n_items)).cast("long"), "batch_in_epoch": F.floor(F.pmod(u, F.lit(n_items)) / F.lit(per_batch)).cast("long"),
        "batches_seen": F.floor(u / F.lit(per_batch)).cast("long"), "samples_seen": (u + 1).cast("long"),
    }


def updates(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last).withColumnRenamed("id", "update_id")
