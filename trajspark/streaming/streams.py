"""Structured Streaming: commit-aware ingestion, generations that replace rows, rolling shards, bounded caches and sessions that end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: str | StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files in the order of their times."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, then stop; results in a table in memory (tests and small outputs)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def to_parquet(df: DataFrame, path: str, checkpoint: str, shard_steps: int | None = None):
    """The file sink: exactly once by the checkpoint's offsets; shards by ranges of optimizer steps."""
    if shard_steps:
        df = df.withColumn("shard", F.floor(F.col("optimizer_step") / F.lit(shard_steps)).cast("int"))
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy("shard") if shard_steps else writer).trigger(availableNow=True).start()


def commit_join(records: DataFrame, commits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Records whose (attempt, step) was committed, as a stream-stream join; both need an ``at`` time.

    The watermark and the time range bound the state: a record that no commit
    follows within the delay is dropped.
    """
    r = records.withWatermark("at", delay).alias("r")
    k = commits.withWatermark("at", delay).alias("c")
    on = (
        (F.col("r.training_attempt_id") == F.col("c.training_attempt_id")) & (F.col("r.optimizer_step") == F.col("c.optimizer_step"))
        & (F.col("c.at") >= F.col("r.at")) & (F.col("c.at") <= F.col("r.at") + F.expr(f"interval {delay}"))
    )
    return r.join(k, on, "inner").select("r.*")


def uncommitted(records: DataFrame, commits: DataFrame) -> DataFrame:
    """Batch side at finalisation: records that no commit released, by attempt and step."""
    lost = records.join(commits.select("training_attempt_id", "optimizer_step"), ["training_attempt_id", "optimizer_step"], "left_anti")
    return lost.groupBy("training_attempt_id", "optimizer_step").agg(F.count(F.lit(1)).alias("dropped"))


def latest_generation(records: DataFrame) -> DataFrame:
    """Greatest generation of each occurrence so far (update or complete mode)."""
    return records.groupBy("occurrence_id").agg(F.max("resume_generation").alias("resume_generation"))


def accepted_changes(stream: DataFrame, key: str = "occurrence_id", generation: str = "resume_generation") -> DataFrame:
    """Rows that replace each other by generation, as changes: the stream's columns after ``op``.

    'add' brings a row of the greatest generation so far, 'retract' (with nulls
    but for key and generation) takes back all rows of a generation that a
    greater one has replaced, 'late' is a row that came too late to be
    accepted.  The state of a key is its greatest generation, not its rows:
    :func:`ledger.replaced` applies the changes.
    """
    kinds = dict(stream.dtypes)
    columns = list(kinds)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        for frame in frames:
            top = int(frame[generation].max())
            if best is not None and top > best:
                gone = {c: [None] for c in columns} | {"op": ["retract"], key: [k[0]], generation: [best]}
                yield pd.DataFrame(gone)[["op", *columns]].astype(object)
            best = top if best is None else max(best, top)
            op = (frame[generation] == best).map({True: "add", False: "late"})
            yield frame.assign(op=op)[["op", *columns]]
        state.update((best,))

    schema = ", ".join(["op string", *[f"`{c}` {t}" for c, t in kinds.items()]])
    return stream.groupBy(key).applyInPandasWithState(update, schema, "best long", "append", GroupStateTimeout.NoTimeout)


def shard_roll(steps: DataFrame, shard_steps: int, run: str = "run", step: str = "step") -> DataFrame:
    """Shards of committed steps that roll at the run's own length; each run's steps come in order.

    A shard starts at the first step after the one before, and ends with the
    step that makes it ``shard_steps`` long or longer, gaps included.  After
    each batch the shards closed in it and the one still open are emitted:
    (run, shard, first_step, last_step, records, closed).  A step at or before
    the end of a closed shard is an error of the source and is emitted as a
    shard of its own, numbered -1.  The state of a run is its open shard.
    """
    kinds = dict(steps.dtypes)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard, first, last, n, closed_to = state.get if state.exists else (0, None, None, 0, None)
        counts: dict[int, int] = {}
        for frame in frames:
            for s, c in zip(*np.unique(frame[step].to_numpy(), return_counts=True), strict=True):
                counts[int(s)] = counts.get(int(s), 0) + int(c)
        rows = []
        for s in sorted(counts):
            if closed_to is not None and s <= closed_to:
                rows.append((k[0], -1, s, s, counts[s], True))
                continue
            first, last, n = s if first is None else min(first, s), s if last is None else max(last, s), n + counts[s]
            if last - first + 1 >= shard_steps:
                rows.append((k[0], shard, first, last, n, True))
                shard, first, last, n, closed_to = shard + 1, None, None, 0, last
        if first is not None:
            rows.append((k[0], shard, first, last, n, False))
        state.update((shard, first, last, n, closed_to))
        yield pd.DataFrame(rows, columns=[run, "shard", "first_step", "last_step", "records", "closed"])

    return steps.groupBy(run).applyInPandasWithState(
        update, f"`{run}` {kinds[run]}, shard long, first_step long, last_step long, records long, closed boolean",
        "shard long, first_step long, last_step long, records long, closed_to long", "append", GroupStateTimeout.NoTimeout,
    )


def rolled(emitted: DataFrame, run: str = "run") -> DataFrame:
    """All closed shards of a ledger's table, and of the open ones that which the run's last batch left open."""
    latest = emitted.groupBy(run).agg(F.max("batch").alias("__last"))
    rows = emitted.join(latest, run)
    return rows.filter(F.col("closed") | (F.col("batch") == F.col("__last"))).drop("__last", "batch")


class _Idle:
    """State that ends: a key that nothing reaches for ``idle`` (in event time, by the stream's watermark) leaves the state."""

    def __init__(self, at: str | None, idle: str | None, delay: str):
        self.at, self.delay = at, delay
        self.ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
        self.mode = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout

    def grouped(self, stream: DataFrame, key: str):
        if self.ms is None:
            return stream.groupBy(key)
        return stream.withWatermark(self.at, self.delay).withColumn("__ms", F.unix_millis(F.col(self.at).cast("timestamp"))).groupBy(key)

    def ended(self, state: GroupState) -> bool:
        if state.hasTimedOut:
            state.remove()
            return True
        return False

    def seen(self, frame: pd.DataFrame, latest: int) -> int:
        return max(latest, int(frame["__ms"].max())) if self.ms is not None and len(frame) else latest

    def keep(self, state: GroupState, value: tuple, latest: int) -> None:
        state.update(value)
        if self.ms is not None:
            state.setTimeoutTimestamp(max(latest + self.ms, state.getCurrentWatermarkMs() + 1))


def latest_n(stream: DataFrame, key: str, order: str, value: str, n: int, at: str | None = None, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """A slot cache of the n latest values of each key; the lowest order is evicted. Emits the cache's content after each batch."""
    life = _Idle(at, idle, delay)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if life.ended(state):
            return
        held, latest = list(zip(*state.get, strict=True)) if state.exists else [], 0
        for frame in frames:
            latest = life.seen(frame, latest)
            held = sorted([*held, *zip(frame[order].tolist(), frame[value].tolist(), strict=True)])[-n:]
        life.keep(state, ([h[0] for h in held], [h[1] for h in held]), latest)
        yield pd.DataFrame({key: [k[0]] * len(held), order: [h[0] for h in held], value: [h[1] for h in held]})

    kinds = dict(stream.dtypes)
    return life.grouped(stream, key).applyInPandasWithState(
        update, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}",
        f"orders array<{kinds[order]}>, vals array<{kinds[value]}>", "update", life.mode,
    )


def sessions(stream: DataFrame, at: str | None = None, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """A session machine over (session, seq, op, frames): 'reset' starts anew, 'cache' moves the frame cursor, 'infer' reads it.

    Speculative frames ('predict') count until the next 'cache' confirms or
    replaces them.  With ``idle``, a session that has ended starts anew if it
    comes back.
    """
    life = _Idle(at, idle, delay)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if life.ended(state):
            return
        (cursor, predicted, resets), latest = state.get if state.exists else (0, 0, 0), 0
        rows = []
        for frame in frames:
            latest = life.seen(frame, latest)
            for seq, op, n in frame.sort_values("seq")[["seq", "op", "frames"]].itertuples(index=False):
                if op == "reset":
                    cursor, predicted, resets = 0, 0, resets + 1
                elif op == "cache":
                    cursor, predicted = cursor + int(n), 0
                elif op == "predict":
                    predicted += int(n)
                rows.append((k[0], int(seq), op, cursor, predicted, resets))
        life.keep(state, (cursor, predicted, resets), latest)
        yield pd.DataFrame(rows, columns=["session", "seq", "op", "cursor", "predicted", "resets"])

    kind = dict(stream.dtypes)["session"]
    return life.grouped(stream, "session").applyInPandasWithState(
        update, f"session {kind}, seq long, op string, cursor long, predicted long, resets long", "cursor long, predicted long, resets long", "append", life.mode,
    )


def ensemble(stream: DataFrame, key: str, order: str, vector: str, horizon: int, alpha: float, at: str | None = None, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Softmax(alpha * cosine) weighted mean of the latest vectors of each key; an order of -1 clears the key's history."""
    life = _Idle(at, idle, delay)

    def cosine(a: list[float], b: list[float]) -> float:
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size > 0 else 0.0

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if life.ended(state):
            return
        held, latest = [list(v) for v in state.get[0]] if state.exists else [], 0
        rows = []
        for frame in frames:
            latest = life.seen(frame, latest)
            for place, v in frame.sort_values(order)[[order, vector]].itertuples(index=False):
                if place < 0:
                    held = []
                    continue
                held = [*held, list(map(float, v))][-horizon:]
                weights = [math.exp(alpha * cosine(h, held[-1])) for h in held]
                rows.append((k[0], place, [sum(w * h[i] for w, h in zip(weights, held, strict=True)) / sum(weights) for i in range(len(held[-1]))]))
        life.keep(state, (held,), latest)
        yield pd.DataFrame(rows, columns=[key, order, "ensemble"])

    kinds = dict(stream.dtypes)
    return life.grouped(stream, key).applyInPandasWithState(
        update, f"{key} {kinds[key]}, {order} {kinds[order]}, ensemble array<double>", "held array<array<double>>", "append", life.mode
    )


def status_snapshots(stream: DataFrame, target: str, checkpoint: str):
    """Running sums by run, appended as JSON lines after each batch."""
    sums = stream.groupBy("run").agg(F.sum("succ_num").alias("succ"), F.sum("total_num").alias("total"))

    def append(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("append").json(target)

    return sums.writeStream.outputMode("complete").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def next_action(requests: DataFrame, actions: DataFrame) -> DataFrame:
    """Replay: the n-th call of a session gets the action at step n of the recording; calls past its end get none.

    A session's calls of one batch are numbered in the order of ``seq``.  They
    come in several frames without order, so the numbers of all of them are
    held (8 bytes each) until the last frame is there.
    """

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (called,) = state.get if state.exists else (0,)
        calls = np.sort(np.concatenate([frame["seq"].to_numpy(np.int64) for frame in frames]))
        state.update((called + len(calls),))
        yield pd.DataFrame({"session": [k[0]] * len(calls), "seq": calls, "step": np.arange(called, called + len(calls))})

    calls = requests.groupBy("session").applyInPandasWithState(count, "session long, seq long, step long", "called long", "append", GroupStateTimeout.NoTimeout)
    return calls.join(actions, "step", "left")
