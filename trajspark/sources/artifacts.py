"""Artifacts of episodes: array files behind a manifest, and data sets that are views of others.

Array files are written where their rows lie.  A task attempt writes into a
folder of its own and lists what it wrote in one manifest file; the commit
writes a marker that names the manifests of the attempts that succeeded.
Readers begin at the marker, so files of lost, repeated or aborted attempts
are never seen, and only one name for each task goes through the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import scratch
from ..operators import contracts, quality, selectors
from . import sinks

#: The arrays of a sidecar file.
ACTION, MASK, FRAME_IDS, ANCHOR = "action_19d", "loss_mask_19d", "source_frame_ids", "episode_anchor_12d"
COUNTS = ("source_length", "real_action_count", "zero_prefix_count", "tail_discarded_count")
DIGEST = "source_parquet_sha256"

MARKER, VIEW_MARKER = "_SIDECARS.json", "_VIEW.json"
#: Bytes of (compressed) files that a task reads, and of decoded arrays in a batch.
TASK_BYTES, BATCH_BYTES = 4_000_000, 16_000_000

WRITTEN = "name STRING, action ARRAY<ARRAY<FLOAT>>, anchor ARRAY<FLOAT>, source_length LONG, source_sha256 STRING"
_MANIFEST = "name STRING, path STRING, bytes LONG, sha256 STRING"
READ = (
    "name STRING, path STRING, error STRING, action ARRAY<ARRAY<FLOAT>>, mask ARRAY<ARRAY<BOOLEAN>>, source_frame_ids ARRAY<LONG>, anchor ARRAY<FLOAT>, "
    "source_length LONG, real_action_count LONG, zero_prefix_count LONG, tail_discarded_count LONG, source_sha256 STRING"
)


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a path (a local folder, or any scheme that pyarrow knows) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def encode(action: np.ndarray, anchor: np.ndarray, source_length: int, source_sha256: str) -> bytes:
    """A sidecar as a compressed archive of arrays; its mask is open and its frame ids count from the first real action."""
    real = len(action) - contracts.ZERO_PREFIX
    out = io.BytesIO()
    np.savez_compressed(out, **{
        ACTION: np.ascontiguousarray(action, np.float32), MASK: np.ones(action.shape, bool), ANCHOR: np.asarray(anchor, np.float32),
        FRAME_IDS: np.concatenate([np.full(contracts.ZERO_PREFIX, -1, np.int64), np.arange(real, dtype=np.int64)]),
        **dict(zip(COUNTS, map(np.int64, (source_length, real, contracts.ZERO_PREFIX, source_length - real)), strict=True)), DIGEST: np.asarray(source_sha256),
    })
    return out.getvalue()


def decode(data: bytes) -> dict:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        action, mask = np.asarray(found[ACTION], np.float32), np.asarray(found[MASK], bool)
        if action.ndim != 2 or mask.ndim != 2:
            raise ValueError("a sidecar's action and mask are rows of channels")
        return {
            "action": action, "mask": mask, "source_frame_ids": np.asarray(found[FRAME_IDS], np.int64),
            "anchor": np.asarray(found[ANCHOR], np.float32), **{c: int(found[c]) for c in COUNTS}, "source_sha256": str(found[DIGEST]),
        }


def _tables(found: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays of two dimensions as lists of lists, from their values as they lie; None is null."""
    there = [x for x in found if x is not None]
    widths = np.concatenate([np.full(len(x), x.shape[1], np.int64) for x in there] or [np.zeros(0, np.int64)])
    values = pa.array(np.concatenate([x.reshape(-1) for x in there]) if there else [], kind.value_type.value_type)
    rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32()), values)
    starts = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in found])])
    offsets = pa.array(starts, pa.int32(), mask=np.array([*(x is None for x in found), False]))
    return pa.ListArray.from_arrays(offsets, rows).cast(kind)


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote."""

    attempt: str
    files: int
    bytes: int


class _SidecarWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.path)
        attempt, files, size = uuid.uuid4().hex, 0, 0
        fs.create_dir(f"{root}/files/{attempt}")
        fs.create_dir(f"{root}/manifest")
        with fs.open_output_stream(f"{root}/manifest/{attempt}.jsonl") as listed:
            for batch in iterator:
                columns = {n: batch.column(n) for n in batch.schema.names}
                for i, name in enumerate(columns["name"].to_pylist()):
                    rows = columns["action"][i].values
                    if name is None or rows is None:
                        raise ValueError("a sidecar needs a name and its actions")
                    widths = set(rows.value_lengths().to_pylist())
                    if len(widths) != 1 or len(rows) < contracts.ZERO_PREFIX:
                        raise ValueError(f"sidecar {name}: {len(rows)} rows of widths {sorted(widths)[:5]}")
                    action = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                    data = encode(action, columns["anchor"][i].as_py(), columns["source_length"][i].as_py(), columns["source_sha256"][i].as_py())
                    at = f"files/{attempt}/{files:06d}.npz"
                    with fs.open_output_stream(f"{root}/{at}") as out:
                        out.write(data)
                    listed.write(json.dumps({"name": name, "path": at, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}).encode() + b"\n")
                    files, size = files + 1, size + len(data)
        return Written(attempt, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        done = [m for m in messages if m is not None]
        before = None if self.overwrite else _marker(self.path)
        marker = {
            "attempts": sorted([*(before["attempts"] if before else []), *(m.attempt for m in done if m.files)]),
            "files": sum(m.files for m in done) + (before["files"] if before else 0), "bytes": sum(m.bytes for m in done) + (before["bytes"] if before else 0),
        }
        beside = f"{root}/.{MARKER}.{uuid.uuid4().hex}"
        with fs.open_output_stream(beside) as out:
            out.write(json.dumps(marker).encode())
        fs.move(beside, f"{root}/{MARKER}")
        self._clear(set(marker["attempts"]))

    def abort(self, messages: list[Written | None]) -> None:
        before = _marker(self.path)
        self._clear(set(before["attempts"]) if before else set())

    def _clear(self, kept: set[str]) -> None:
        """Remove what no marker names; there is one writer at a time."""
        from pyarrow import fs as stores

        fs, root = _store(self.path)
        for info in fs.get_file_info(stores.FileSelector(f"{root}/files", allow_not_found=True)):
            if info.base_name not in kept:
                fs.delete_dir(info.path)
        for info in fs.get_file_info(stores.FileSelector(f"{root}/manifest", allow_not_found=True)):
            if info.base_name.removesuffix(".jsonl") not in kept:
                fs.delete_file(info.path)


def _marker(path: str) -> dict | None:
    fs, root = _store(path)
    try:
        with fs.open_input_stream(f"{root}/{MARKER}") as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


class SidecarFiles(DataSource):
    """A sink of sidecar files: ``df.write.format("sidecar_files").mode(...).save(path)`` for rows of ``WRITTEN``."""

    @classmethod
    def name(cls) -> str:
        return "sidecar_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _SidecarWriter(self.options["path"], overwrite)


def write_sidecars(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One array file for each row (name, action with its prefix of zeros, anchor, source_length, source_sha256)."""
    spark = rows.sparkSession
    spark.dataSource.register(SidecarFiles)
    kinds = [f.split(" ", 1) for f in WRITTEN.split(", ")]
    rows.select(*[F.col(n).cast(t) for n, t in kinds]).write.format(SidecarFiles.name()).mode(mode).save(path)


def _opened(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path)
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            nested = {"action", "mask"}
            columns = [_tables([r.get(f.name) for r in rows], f.type) if f.name in nested else pa.array([r.get(f.name) for r in rows], f.type) for f in schema]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for listed in batch.to_pylist():
                row = {"name": listed["name"], "path": listed["path"], "error": None}
                try:
                    with fs.open_input_stream(f"{root}/{listed['path']}") as f:
                        data = f.read()
                    if hashlib.sha256(data).hexdigest() != listed["sha256"]:
                        row["error"] = "changed"
                    else:
                        row |= decode(data)
                        size += row["action"].size * 32
                except FileNotFoundError:
                    row["error"] = "missing"
                except (EOFError, KeyError, ValueError, zipfile.BadZipFile):
                    row["error"] = "unreadable"
                rows.append(row)
                size += 1_000
                if size > BATCH_BYTES:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    return run


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """The files of the last commit; ``error`` is 'missing', 'changed' (another digest than when written) or 'unreadable', else null."""
    path = path.rstrip("/")
    marker = _marker(path)
    if marker is None:
        raise FileNotFoundError(f"{path}: no commit of sidecars")
    if not marker["attempts"]:
        return spark.createDataFrame([], READ)
    listed = spark.read.schema(_MANIFEST).json([f"{path}/manifest/{a}.jsonl" for a in marker["attempts"]])
    # the manifest is dealt out by what its files weigh; the files themselves are opened where they are decoded
    return listed.repartition(1 + marker["bytes"] // TASK_BYTES).mapInArrow(_opened(path, to_arrow_schema(StructType.fromDDL(READ))), READ)


def sidecar_faults(sidecars: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, rule) for each source (name, raw_length, raw_sha256) whose sidecar can't be reused; repeated names of sidecars are a fault of their own."""
    # the files are decoded once, where they lie: only facts of fixed size meet the sources, whichever side of the join is sent
    judged = scratch.materialize(contracts.sidecar_facts(sidecars, "name", "error"), "judged")
    named = judged.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    state = sources.select("name").join(named, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    absent = quality.violations(state, "name", {"no_sidecar": F.col("n") == 0, "repeated_sidecar": F.col("n") > 1})
    unread = judged.filter("error is not null").select(F.col("name").alias("key"), F.col("error").alias("rule"))
    both = judged.filter("error is null").join(sources.select("name", "raw_length", "raw_sha256"), "name")
    return absent.unionByName(unread.join(sources.select(F.col("name").alias("key")), "key", "left_semi")).unionByName(contracts.fact_rules(both, "name"))


def write_view(episodes: DataFrame, manifest: DataFrame, info: dict, source: str, path: str) -> dict:
    """A data set that holds only metadata: the episodes and configs that a manifest names, over the data of ``source``.

    The metadata are written first and the marker, which names the source and
    counts what was kept, last; nothing of the source is copied.  A manifest
    that names no config of any episode is an error and leaves no marker.
    """
    path = path.rstrip("/")
    spark = episodes.sparkSession
    kept = episodes.drop("action_config").join(selectors.filter_configs(episodes, manifest), "episode")
    jvm, _, place, fs = sinks._file_system(f"{path}/{VIEW_MARKER}")
    fs.delete(place, False)
    sinks.jsonl(kept, f"{path}/meta/episodes", mode="overwrite")
    written = spark.read.schema(kept.schema).json(f"{path}/meta/episodes")
    counted = written.agg(F.count(F.lit(1)).alias("e"), F.coalesce(F.sum(F.size("action_config")), F.lit(0)).alias("c")).first()
    if not counted["e"]:
        raise ValueError(f"no config of any episode is in the manifest of {path}")
    segments = manifest.count()
    summary = {"selected_episodes": counted["e"], "manifest_segments": segments, "kept_segments": counted["c"], "dropped_manifest_segments": segments - counted["c"]}
    sinks.atomic_json(f"{path}/meta/info.json", info | {"total_episodes": counted["e"]})
    sinks.atomic_json(f"{path}/{VIEW_MARKER}", summary | {"source": source, "schema": kept.schema.jsonValue()})
    return summary


def view_episodes(spark: SparkSession, path: str) -> DataFrame:
    """The episodes of a view, with the configs that were kept."""
    marker = sinks.read_json(f"{path.rstrip('/')}/{VIEW_MARKER}")
    if marker is None:
        raise FileNotFoundError(f"{path}: no view")
    return spark.read.schema(StructType.fromJson(marker["schema"])).json(f"{path.rstrip('/')}/meta/episodes")


def view_rows(spark: SparkSession, path: str, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """The source's rows of a view's episodes; where the source is partitioned by one of ``by``, partitions without a kept episode are not read."""
    source = sinks.read_json(f"{path.rstrip('/')}/{VIEW_MARKER}")["source"]
    rows = spark.read.parquet(source)
    wanted = [*by, *[c for c in columns if c not in by]] if columns else rows.columns
    return rows.select(*wanted).join(view_episodes(spark, path).select(*by).distinct(), by, "left_semi")
