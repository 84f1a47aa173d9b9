"""Periodic runs of words: maximal repetitions by a harmonic grid and prefix hashes.

A run is a stretch of consecutive words with smallest period q, at least
``LEAST`` words and at least 2q long, that no neighbouring word extends.

Any stretch of period q and 2q words or more covers a multiple i of q, counted
from its text's first word, with i + q inside too and less than q words before
i.  So the pairs (q, i) of all periods and their multiples, n ln n in all, meet
every run.  Pairs whose words i and i + q differ go at once.  For all others
together, the longest common extensions of i and i + q in both directions are
found by binary search over prefix hashes; together they give the stretch.
Equal words always have equal hashes, so an extension is never too short, and
every stretch that is kept is verified word by word; where that fails (hashes
modulo 2^64 can be fooled) the text's extensions are found by comparing words.
Several grid points meet one run: stretches are told apart by their ends.  Of
equal ends the smallest period is the run's, since periods of a stretch of two
periods are multiples of the smallest one.

Many short texts are searched at once, and the pairs of a long one in slices.

Defined results: a null or empty text has no words, no run and an empty
collapsed text; rows are independent, so ties, repeated rows and null ids need
no rule; an empty table gives an empty result; columns named in ``keep`` are
passed on, others aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .wordhash import mix

LEAST = 12
#: Bytes of texts searched at once, and pairs of a slice: bounds the temporary arrays.
GROUP, PAIRS = 1 << 19, 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x5851F42D4C957F2D)
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Extensions:
    """Longest common extensions of pairs of places in a sequence of word numbers."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        power = np.full(len(ids) + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.cumprod(power, dtype=np.uint64)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def _same(self, at: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        own = (self.sums[at + n] - self.sums[at]) * self.power[q]
        return own == self.sums[at + q + n] - self.sums[at + q]

    def forward(self, at: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words from ``at`` that equal those q later, at most ``most``; all pairs at once."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self._same(at, q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def backward(self, at: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self._same(at - middle, q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def compared(self, at: int, q: int, first: int, end: int) -> tuple[int, int]:
        """Both extensions of one pair by the words themselves."""
        ahead, behind = self.ids[at : end - q] != self.ids[at + q : end], self.ids[first:at] != self.ids[first + q : at + q]
        return int(ahead.argmax()) if ahead.any() else len(ahead), int(behind[::-1].argmax()) if behind.any() else len(behind)


def _grid(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of the pairs of a place and the place a period later, in slices."""
    half = n // 2
    text = np.repeat(np.arange(len(n)), half)
    q = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    counts = (n[text] - q - 1) // q + 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(q):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        c = counts[at:stop]
        row = np.repeat(np.arange(at, stop), c)
        multiple = np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
        yield text[row], q[row], first[text[row]] + multiple * q[row]
        at = stop


def _dedupe(text: np.ndarray, start: np.ndarray, length: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Stretches told apart by text and ends; of equal ones the smallest period stays."""
    found = np.stack([text, start, length, q], 1)
    found = found[np.lexsort((q, length, start))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, 1:3] != found[:-1, 1:3]).any(1)
    return found[fresh]


def find_runs(ids: np.ndarray, first: np.ndarray, n: np.ndarray, least: int = LEAST, by_hash: bool = True) -> np.ndarray:
    """Runs of several texts laid end to end as rows (text, start, length, period), starts counted over all texts."""
    ext = _Extensions(ids)
    parts = [np.empty((0, 4), np.int64)]
    for text, q, at in _grid(first, n):
        kept = np.flatnonzero(ids[at] == ids[at + q])
        text, q, at = text[kept], q[kept], at[kept]
        if by_hash:
            ahead, behind = ext.forward(at, q, first[text] + n[text] - at - q), ext.backward(at, q, at - first[text])
        else:
            both = [ext.compared(a, p, first[t], first[t] + n[t]) for t, p, a in zip(text.tolist(), q.tolist(), at.tolist(), strict=True)]
            ahead, behind = np.array(both, np.int64).reshape(-1, 2).T
        length = ahead + behind + q
        kept = length >= np.maximum(least, 2 * q)
        parts.append(_dedupe(text[kept], (at - behind)[kept], length[kept], q[kept]))
    found = _dedupe(*np.concatenate(parts).T)
    if not by_hash:
        return found
    wrong = sorted({t for t, s, length, q in found.tolist() if not np.array_equal(ids[s : s + length - q], ids[s + q : s + length])})
    for t in wrong:
        again = find_runs(ids[first[t] : first[t] + n[t]], np.zeros(1, np.int64), n[t : t + 1], least, False)
        again += np.array([t, first[t], 0, 0])
        found = np.concatenate([found[found[:, 0] != t], again])
    return found[np.lexsort((found[:, 3], found[:, 1]))]


def collapse(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words of each text, runs as :func:`find_runs` with starts in their texts, texts with each run cut to its first period)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    solid = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0, append=0))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    body = data[solid]
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    bounds = np.searchsorted(starts, begin)
    first, n = bounds[:-1], np.diff(bounds)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = find_runs(ids, first, n, least)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    keep = np.cumsum(edge)[:-1] == 0
    # every word and one space after it, then the bytes of the words that stay
    spaced = np.full(len(body) + len(sizes), 0x20, np.uint8)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(spaced), bool)
    inside[ends - 1] = False
    spaced[inside] = body
    spaced = spaced[np.repeat(keep, sizes + 1)]
    cuts = np.concatenate([[0], np.cumsum((sizes + 1) * keep)])[bounds]
    out = [spaced[a : max(a, b - 1)].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    runs[:, 1] -= first[runs[:, 0]]
    return n, runs, out


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    texts, at, held, size = batch.column(0), 0, [], 0
    for i in range(len(texts)):
        held.append(texts[i].as_py() or b"")
        size += len(held[-1])
        if size >= GROUP or i == len(texts) - 1:
            yield at, held
            at, held, size = i + 1, [], 0


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """The columns ``keep``, then n_words, runs (start, length, period in words, by start and period) and the collapsed text of every row."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for at, texts in _groups(batch):
                n, runs, collapsed = collapse(texts, least)
                offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in (1, 2, 3)], fields=list(RUNS.value_type))
                own = [batch.column(1 + k).slice(at, len(texts)) for k in range(len(keep))]
                columns = [*own, pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), structs), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(text).cast("binary").alias("__text"), *keep)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keep], "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"])
    return rows.mapInArrow(search, schema)
