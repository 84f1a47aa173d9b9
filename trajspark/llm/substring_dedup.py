"""Exact removal of repeated word passages by fixed-block anchors.

Words are maximal runs of characters other than space and 09-0D.  A window is
``WINDOW`` consecutive words; a word goes if a window that covers it has a
word sequence that also starts in a document with a smaller doc_id.

1. Every document is cut into non-overlapping blocks of ``BLOCK`` words.  Any
   window holds at least one whole block, so a repeat of it elsewhere holds
   that block at some offset.  The block hashes make a fixed-size filter.
2. Every rolling window of ``BLOCK`` words probes the filter.  Hits are grouped
   by hash: an anchor is a block that starts, at any offset, in a document
   with a larger doc_id than the smallest that has it as a block.
3. Only windows that contain an anchor are looked at further: they are grouped
   by hash, each with its smallest doc_id.  Windows of documents with a larger
   one are repeats, and overlapping ones merge into maximal exact repeats,
   which are all that goes back to the texts.

Two independent 64-bit hashes (block and window) must agree for a repeat.
Groups hold one pre-aggregated row for each task, never the pairs of a group.

Defined results: a null text has no words; rows with one doc_id never remove
each other's words (so rows without a doc_id never do); a null doc_id counts
as larger than any; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced
from .wordhash import BitFilter, Windows, hash_words

WINDOW, BLOCK = 50, 25
#: Blocks for each document assumed when the filter is sized (at most ``BitFilter.MOST_BITS``).
EXPECTED_BLOCKS = 32
BLOCK_BASE, WINDOW_BASE = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1
#: Bytes of passages up to which they are broadcast to the texts.
BROADCAST_BYTES = 32_000_000


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _block_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows = Windows(BLOCK, BLOCK_BASE)
    for batch in sliced(batches):
        own = [windows(hash_words(t))[::BLOCK] for t in _texts(batch, 1)]
        if own:
            h = np.unique(np.concatenate(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(BitFilter.slice_of(h).astype(np.int32)), _signed(h)], names=["slice", "h"]
            )


def _filter_slices(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = bits // BitFilter.SLICES // 8
        own: BitFilter | None = None
        seen: set[int] = set()
        for batch in batches:
            own = own or BitFilter(bits)
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            own.add(h)
            seen.update(np.unique(BitFilter.slice_of(h)).tolist())
        if own is not None:
            kept = sorted(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.int32()), pa.array([own.data[s * per : (s + 1) * per].tobytes() for s in kept], pa.binary())],
                names=["slice", "bits"],
            )

    return build


def _collect_filter(hashes: DataFrame, bits: int) -> BitFilter:
    """The filter of all hashes: built slice by slice on the executors; ``bits / 8`` bytes reach the driver."""
    built = hashes.select("slice", "h").repartition(BitFilter.SLICES // 4, "slice").mapInArrow(_filter_slices(bits), "slice int, bits binary")
    out = BitFilter(bits)
    per = bits // BitFilter.SLICES // 8
    for row in built.toLocalIterator():
        part = out.data[row["slice"] * per : (row["slice"] + 1) * per]
        np.bitwise_or(part, np.frombuffer(row["bits"], np.uint8), out=part)
    return out


def _probes(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bloom = Windows(BLOCK, BLOCK_BASE), BitFilter(*shared.value)
        for batch in sliced(batches):
            hs, docs, starts = [], [], []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, text in zip(ids, _texts(batch, 1), strict=True):
                h = windows(hash_words(text))
                hit = np.nonzero(bloom.has(h))[0]
                if len(hit):
                    hs.append(h[hit])
                    docs.append(np.full(len(hit), doc, np.int64))
                    starts.append(hit % BLOCK == 0)
            if not hs:
                continue
            h, doc, aligned = np.concatenate(hs), np.concatenate(docs), np.concatenate(starts)
            order = np.argsort(h, kind="stable")
            h, doc, aligned = h[order], doc[order], aligned[order]
            first = np.nonzero(np.diff(h, prepend=~h[:1]) != 0)[0]
            least = np.minimum.reduceat(np.where(aligned, doc, LAST), first)
            most = np.maximum.reduceat(doc, first)
            yield pa.RecordBatch.from_arrays([_signed(h[first]), pa.array(least), pa.array(most)], names=["h", "least", "most"])

    return run


def _candidates(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["w", "doc_id", "row", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, windows, bloom = Windows(BLOCK, BLOCK_BASE), Windows(WINDOW, WINDOW_BASE), BitFilter(*shared.value)
        for batch in sliced(batches):
            ws, docs, rows, starts = [], [], [], []
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            for doc, row, text in zip(ids, keys, _texts(batch, 1), strict=True):
                words = hash_words(text)
                if len(words) < WINDOW:
                    continue
                hit = bloom.has(blocks(words))
                if not hit.any():
                    continue
                # a window holds the blocks that start in its first WINDOW - BLOCK + 1 words
                upto = np.concatenate([[0], np.cumsum(hit)])
                reach = WINDOW - BLOCK + 1
                start = np.nonzero(upto[reach:] - upto[:-reach] > 0)[0]
                ws.append(windows(words)[start])
                docs.append(np.full(len(start), doc, np.int64))
                rows.append(np.full(len(start), row, np.int64))
                starts.append(start.astype(np.int32))
            if ws:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(ws)), *(pa.array(np.concatenate(x)) for x in (docs, rows, starts))], names=names
                )

    return run


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only what the passes read; row tells texts of one doc_id apart."""
    return docs.select(_own_id(key), F.col(text).alias("text"), F.xxhash64(text).alias("row"))


def _own_id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc_id")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats: first words and ends of the words that the windows cover."""
    for batch in batches:
        firsts, ends = [], []
        for starts in batch.column(2):
            own = np.sort(starts.values.to_numpy())
            cut = np.nonzero(np.diff(own) > WINDOW)[0] + 1
            firsts.append(own[np.concatenate([[0], cut])])
            ends.append(own[np.concatenate([cut - 1, [len(own) - 1]])] + WINDOW)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in (firsts, ends))], names=["doc_id", "row", "firsts", "ends"]
        )


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, firsts, ends): the words to remove, for each text that has any; row is the text's 64-bit hash."""
    spark = docs.sparkSession
    rows = _keyed(docs, key, text)
    plain = rows.select("doc_id", "text")
    bits = BitFilter.sized(rows.select("doc_id").count() * EXPECTED_BLOCKS)

    blocks = _collect_filter(plain.mapInArrow(_block_hashes, "slice int, h long"), bits)
    sent = spark.sparkContext.broadcast((bits, blocks.data))
    hits = plain.mapInArrow(_probes(sent), "h long, least long, most long")
    anchors = hits.groupBy("h").agg(F.min("least").alias("least"), F.max("most").alias("most")).filter("least < most")
    sliced = anchors.select(F.shiftrightunsigned("h", 58).cast("int").alias("slice"), "h")
    shared = spark.sparkContext.broadcast((bits, _collect_filter(sliced, bits).data))
    sent.unpersist()

    found = materialize(rows.mapInArrow(_candidates(shared), "w long, doc_id long, row long, start int"), "windows")
    least = found.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    # written, so that the join below has plain exchanges on both sides: a hot window's rows can be split
    least = materialize(least.select("w", "least"), "repeats")
    repeats = found.join(least, "w").filter("doc_id > least")
    grouped = repeats.groupBy("doc_id", "row").agg(F.collect_set("start").alias("starts"))
    return grouped.mapInArrow(_merged, "doc_id long, row long, firsts array<int>, ends array<int>")


def _kept(batches: Iterator[pa.RecordBatch], position: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts, firsts, ends = _texts(batch, position), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
        total, removed, kept = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            total.append(len(words))
            if firsts[i].is_valid:
                for a, b in zip(reversed(firsts[i].as_py()), reversed(ends[i].as_py()), strict=True):
                    del words[a:b]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-2], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept_text"],
        )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with n_words, n_removed and kept_text (kept words, one space between)."""
    clash = {"n_words", "n_removed", "kept_text"} & set(docs.columns)
    docs = docs.drop(*clash)
    repeats = find_repeats(docs, key, text).select(
        F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("firsts").alias("__firsts"), F.col("ends").alias("__ends")
    )
    repeats = materialize(repeats, "passages")
    size = repeats.agg(F.coalesce(F.sum(F.size("__firsts") * 8 + 64), F.lit(0)).alias("b")).first()["b"]
    # where the passages are few enough the texts stay where they are; else both sides are shuffled
    passages = F.broadcast(repeats) if size <= BROADCAST_BYTES else repeats
    on = (F.col("__k") == F.col("__id")) & (F.col("__h") == F.col("__row"))
    keyed = docs.withColumns({"__k": _own_id(key), "__h": F.xxhash64(text)})
    joined = keyed.join(passages, on, "left").select(*docs.columns, "__firsts", "__ends")
    position = docs.columns.index(text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _kept(batches, position)

    return joined.mapInArrow(run, f"{fields}, n_words long, n_removed long, kept_text string")
