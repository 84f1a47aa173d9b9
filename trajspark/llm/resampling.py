"""Importance resampling towards a target distribution, with overlapping chunks for long texts.

A text's features are its runs of 1 to ``GRAMS`` consecutive words, filed in
``BUCKETS`` buckets by CRC-32.  A bucket's gain is the log ratio of its share
of the target's features to its share of the source's; a document's weight is
the sum of its features' gains.  A Gumbel draw from the hash of the id is
added and the highest scores are drawn, which is sampling without replacement
in proportion to exp(weight).

Texts of more than ``CHUNK`` bytes are split at word boundaries.  A chunk owns
the words that start in it and carries the next ``GRAMS - 1`` words, so that
every feature belongs to exactly one chunk, that of its first word.  Chunks
are written once and dealt to all tasks, and counts and weights of chunks are
summed by document; texts that fit into one chunk never move.

Inside a task words are found and hashed by numpy, many texts at a time: the
CRC of a run of words follows from its words' CRCs, since appending n bytes
acts on a CRC as a linear map that depends on n alone.

Defined results: a null text has no words, a null id is hashed as ``null`` and
comes last among ties; rows that repeat an id are documents of their own;
rows with too few words are never drawn, nor counted in N; an empty table
gives an empty result; only the id and the text of the input are read, so
other columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import order
from .common import materialize, sliced

GRAMS, BUCKETS, SEED = 3, 10_000, 42
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of a chunk's own words; longer texts are split.
CHUNK = 1 << 18
#: Bytes of texts hashed at once: bounds the temporary arrays.
GROUP = 1 << 20
#: Bytes of a word up to which its CRC and its shift come from tables.
SHORT = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_WORD = rb"[^0-9A-Za-z\x80-\xff]*[0-9A-Za-z\x80-\xff]+"


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, k, b]``: what n zero bytes make of byte b at place k of a CRC."""
    tables = np.empty((SHORT + 2, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(SHORT + 1):
        tables[n + 1] = _STEP[tables[n] & 255] ^ (tables[n] >> np.uint32(8))
    return tables


_SHIFT = _shift_tables().ravel()
_SPACE_CRC = np.uint32(zlib.crc32(b" "))


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a prefix with this CRC has in the CRC of the prefix and n more bytes."""
    at = np.minimum(n, SHORT + 1) * 1024
    out = _SHIFT[at + (crc & 255)] ^ _SHIFT[at + 256 + (crc >> 8 & 255)] ^ _SHIFT[at + 512 + (crc >> 16 & 255)] ^ _SHIFT[at + 768 + (crc >> 24)]
    for i in np.flatnonzero(n > SHORT + 1):
        out[i] = zlib.crc32(bytes(int(n[i])), int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def _word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of every word: byte places in turn, words in falling order of length."""
    longest = np.argsort(SHORT - np.minimum(lengths, SHORT), kind="stable")
    at, size = starts[longest], lengths[longest]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    left = np.searchsorted(-size, -np.arange(min(int(size[0]), SHORT)), "left") if len(size) else []
    for k, n in enumerate(left):
        crc[:n] = _STEP[(crc[:n] ^ data[at[:n] + k]) & 255] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(at), np.uint32)
    out[longest] = ~crc
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return out


def features(texts: list[bytes], owned: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, CRC of each feature) for the words that start in the first ``owned`` bytes."""
    data = _LOWER[np.frombuffer(b"\0".join(texts), np.uint8)]
    edges = np.flatnonzero(np.diff(_IN_WORD[data].view(np.int8), prepend=0, append=0))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    text = np.searchsorted(begin, starts, "right") - 1
    own = starts - begin[text] < np.asarray(owned, np.int64)[text]
    words = np.bincount(text[own], minlength=len(texts))
    crc = run = _word_crcs(data, starts, lengths)
    spaced = crc ^ _shifted(np.full(len(crc), _SPACE_CRC), lengths)
    whose, found = [text[own]], [crc[own]]
    for n in range(1, GRAMS):
        if len(crc) <= n:
            break
        run = spaced[n:] ^ _shifted(run[: len(crc) - n], lengths[n:] + 1)
        kept = own[:-n] & (text[:-n] == text[n:])
        whose.append(text[:-n][kept])
        found.append(run[kept])
    return words, np.concatenate(whose), np.concatenate(found)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """Rows of (text, owned) in groups of about ``GROUP`` bytes, each with its first row."""
    texts, owned = batch.column(0), batch.column(1).to_pylist()
    at, held, size = 0, [], 0
    for i in range(len(texts)):
        held.append(texts[i].as_py() or b"")
        size += len(held[-1])
        if size >= GROUP or i == len(texts) - 1:
            yield at, held, owned[at : i + 1]
            at, held, size = i + 1, [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in sliced(batches):
        for _, texts, owned in _groups(batch):
            counts += np.bincount(features(texts, owned)[2] % BUCKETS, minlength=BUCKETS)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["bucket", "n"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of long texts: (uid, doc_id, part, text, owned bytes)."""
    carry = re.compile(_WORD * (GRAMS - 1) + rb"|" + _WORD)
    for batch in sliced(batches, 1):
        text = batch.column(2)[0].as_py()
        at = part = 0
        while at < len(text):
            cut = _BREAK.search(text, at + CHUNK)
            stop = cut.start() if cut else len(text)
            more = carry.match(text, stop)
            piece = text[at : more.end() if more else stop]
            columns = [batch.column(0), batch.column(1), pa.array([part], pa.int32()), pa.array([piece], pa.binary()), pa.array([stop - at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "part", "text", "owned"])
            at, part = stop, part + 1



def _bucket_counts(*chunks: DataFrame) -> np.ndarray:
    """Features of each bucket over all chunks; what comes to the driver is a row for each bucket."""
    rows = [c.select("text", "owned").mapInArrow(_count, "bucket int, n long") for c in chunks]
    union = rows[0]
    for r in rows[1:]:
        union = union.union(r)
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in union.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[bucket] = n
    return counts


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """``floor(1000 * ln(target share / source share))`` of each bucket, one added to every bucket."""
    of_target, of_source = int(target.sum()) + len(target), int(source.sum()) + len(source)
    return np.array([math.floor(1000 * math.log(float(t + 1) * of_source / (float(s + 1) * of_target))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weigh(chunks: DataFrame, gains: np.ndarray, keys: list[str]) -> DataFrame:
    """Words, features and weight of each chunk, after its key columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for at, texts, owned in _groups(batch):
                words, whose, crc = features(texts, owned)
                weight = np.zeros(len(texts), np.int64)
                np.add.at(weight, whose, gains[crc % BUCKETS])
                n = np.bincount(whose, minlength=len(texts)).astype(np.int64)
                own = [batch.column(2 + k).slice(at, len(texts)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], names=[*keys, "n_words", "n_features", "weight"])

    kinds = dict(chunks.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n_words long, n_features long, weight long"])
    return chunks.select("text", "owned", *keys).mapInArrow(run, schema)


def _chunked(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(texts that are one chunk, chunks of longer texts dealt out by themselves)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    size = F.octet_length("text")
    short = rows.filter(size <= CHUNK).withColumn("owned", size.cast("long"))
    long = rows.filter(size > CHUNK).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    parts = long.mapInArrow(_split, f"uid long, doc_id {kind}, part int, text binary, owned long").repartition("uid", "part")
    return short, materialize(parts, "chunks")


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of ``docs`` against the texts of ``target``."""
    short, long = _chunked(docs, key, text)
    wanted = target.select(F.lit(None).cast("long").alias("none"), F.col(text).alias("text"))
    gains = gains_of(_bucket_counts(*_chunked(wanted, "none", "text")), _bucket_counts(short, long))
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    whole = weigh(long, gains, ["uid", "doc_id"]).groupBy("uid", "doc_id").agg(*sums).drop("uid")
    return weigh(short, gains, ["doc_id"]).union(whole)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's weight and score, and its rank among those drawn (``floor(percent * N / 100)`` of the N with enough words)."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))
    scored = weights(docs, target, key, text).withColumn("score", (F.col("weight") + noise).cast("long"))
    # ranks sample the rows before they deal them: the texts are not read again for that
    scored = materialize(scored, "scores").withColumn("__row", F.monotonically_increasing_id())
    fit = scored.filter(F.col("n_words") >= least_words)
    wanted = percent * fit.count() // 100
    ranked = order.numbered(fit, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "__row"], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).union(rest.select(*columns))
