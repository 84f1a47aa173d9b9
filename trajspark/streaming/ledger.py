"""What a stream has committed: a two-phase ledger, the sampler's cursor, and rows that replace each other.

A batch is committed in two phases: its rows are written under its number,
then one small marker that names the batch, and carries a state, is moved into
place.  Readers see batches up to the marker's alone.  A run that dies between
the phases leaves rows that nobody sees and that the same batch overwrites
when it is repeated; one that dies after the marker, but before the engine has
noted it, finds its batch committed and passes over it.  So every batch counts
exactly once, and a state that lies in the marker moves with it or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.packing import Cursor
from ..sources import sinks

#: A test's fault: called with the phase just ended ("written" or "committed") and the batch; what it raises ends the run there.
Fault = Callable[[str, int], None]


class Ledger:
    """Tables of committed batches below one folder of the shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def last(self) -> dict | None:
        """{"batch", "state"} of the last committed batch."""
        return sinks.read_json(f"{self.root}/COMMITTED.json")

    def _place(self, table: str, batch: int) -> str:
        return f"{self.root}/{table}/batch={batch}"

    def commit(self, batch: int, tables: dict[str, DataFrame], state: Callable[[dict | None], dict] | None = None, fault: Fault | None = None) -> bool:
        """Both phases; False where the batch is committed already. ``state`` makes the new state of the old one once the rows are written."""
        last = self.last()
        if last is not None and batch <= last["batch"]:
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(self._place(name, batch))
        if fault:
            fault("written", batch)
        new = state(last["state"] if last else None) if state else {}
        sinks.atomic_json(f"{self.root}/COMMITTED.json", {"batch": batch, "state": new})
        if fault:
            fault("committed", batch)
        return True

    def read(self, table: str, schema: str) -> DataFrame:
        """Rows of the committed batches, with the number of their batch."""
        last = self.last()
        if last is None:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.root}/{table}")
        return rows.filter(F.col("batch") <= last["batch"])

    def read_batch(self, table: str, schema: str, batch: int) -> DataFrame:
        """Rows of one batch, committed or not."""
        return self.spark.read.schema(schema).parquet(self._place(table, batch))


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def into(stream: DataFrame, ledger: Ledger, checkpoint: str, table: str = "rows", mode: str = "append", fault: Fault | None = None) -> StreamingQuery:
    """Every batch of a stream as rows of one table of the ledger; runs to the end of what is there."""

    def one(batch: DataFrame, number: int) -> None:
        if not ledger.commit(number, {table: batch}, fault=fault):
            # a stream with state must still run the batch that it repeats: its state store commits by that
            batch.write.format("noop").mode("overwrite").save()

    return stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def next_missing(cursor: int, ids: DataFrame, column: str = "update_id") -> int:
    """The least id from the cursor on that isn't there: an anti-join of the successors, so no task sees all ids."""
    ahead = ids.filter(F.col(column) >= cursor).select(F.col(column).alias("__u")).distinct()
    steps = ahead.select((F.col("__u") + 1).alias("__n")).union(ids.sparkSession.range(cursor, cursor + 1).toDF("__n"))
    return steps.join(ahead, F.col("__n") == F.col("__u"), "left_anti").agg(F.min("__n")).first()[0]


def run_updates(updates: DataFrame, ledger: Ledger, config: dict, checkpoint: str, column: str = "update_id", fault: Fault | None = None) -> StreamingQuery:
    """Rows of training updates into the ledger; the sampler's cursor moves with the commit, past updates without a gap alone.

    Updates may arrive in any order.  The cursor is the number of updates from
    0 on that have all been committed; those beyond a gap are kept and count
    when it closes.  Only ids beyond the cursor are looked at again.  A ledger
    of another configuration is refused.
    """
    kind = f"{column} long"

    def one(batch: DataFrame, number: int) -> None:
        last = ledger.last()
        cursor = Cursor(config)
        if last is not None:
            cursor.load(last["state"])
        ids = batch.select(F.col(column).cast("long").alias(column)).filter(F.col(column) >= cursor.next_update)
        if last is not None:
            ids = ids.union(ledger.read_batch("ahead", kind, last["batch"]).filter(F.col(column) >= cursor.next_update))

        def state(_: dict | None) -> dict:
            cursor.next_update = next_missing(cursor.next_update, ledger.read_batch("ahead", kind, number), column)
            return cursor.state()

        ledger.commit(number, {"updates": batch, "ahead": ids.distinct()}, state, fault)

    return updates.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def released_updates(ledger: Ledger, schema: str, column: str = "update_id") -> DataFrame:
    """Committed rows of updates before the cursor."""
    last = ledger.last()
    rows = ledger.read("updates", schema)
    return rows.filter(F.col(column) < (last["state"]["next_update"] if last else 0))


def run_changes(
    stream: DataFrame, ledger: Ledger, checkpoint: str, table: str = "rows", key: str = "occurrence_id", generation: str = "resume_generation", fault: Fault | None = None,
) -> StreamingQuery:
    """Rows that replace each other by generation into the ledger, as the changes that :func:`streams.accepted_changes` makes, by joins of whole batches.

    The greatest generation of a key before a batch is read from the rows that
    the ledger has accepted, so nothing runs for each key and the stream has no
    state of its own.
    """
    schema = f"op string, {schema_of(stream)}"

    def one(batch: DataFrame, number: int) -> None:
        held = ledger.read(table, schema).filter("op = 'add'").groupBy(F.col(key).alias("__h")).agg(F.max(generation).alias("__held"))
        top = batch.groupBy(F.col(key).alias("__k")).agg(F.max(generation).alias("__top"))
        keys = top.join(held, F.col("__k").eqNullSafe(F.col("__h")), "left").select("__k", "__held", F.greatest("__top", "__held").alias("__best"))
        judged = batch.join(keys, batch[key].eqNullSafe(F.col("__k")))
        rows = judged.select(F.when(F.col(generation) == F.col("__best"), "add").otherwise("late").alias("op"), *[batch[c] for c in batch.columns])
        of = {key: F.col("__k"), generation: F.col("__held")}
        gone = keys.filter("__best > __held").select(F.lit("retract").alias("op"), *[of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in batch.schema])
        ledger.commit(number, {table: rows.unionByName(gone)}, fault=fault)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replaced(changes: DataFrame, key: str = "occurrence_id", generation: str = "resume_generation") -> DataFrame:
    """What stands after all changes of :func:`streams.accepted_changes`: added rows that no retraction takes back."""
    gone = changes.filter("op = 'retract'").select(F.col(key).alias("__k"), F.col(generation).alias("__g")).distinct()
    added = changes.filter("op = 'add'")
    return added.join(gone, added[key].eqNullSafe(gone["__k"]) & (added[generation] == gone["__g"]), "left_anti").drop("op", "batch")
