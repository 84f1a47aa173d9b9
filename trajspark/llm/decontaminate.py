"""Benchmark leaks by pigeonhole edit matching, verified with Myers' bit-parallel distance.

Texts are lower-cased and their white space made single blanks.  An item of n
characters may differ in ``floor(n * ERROR_RATE)`` edits.  It is cut into one
piece more than that, so any match within the budget keeps a piece intact.
One automaton finds all piece hits of all items in a document; around each
hit the item's least edit distance to a substring is computed exactly.

Defined results: null and empty documents, and empty items, have no match;
one row for each matching (row of documents, item_id) with its best match
(least distance, then first place); items with a null id are one item, whose
row has a null item_id; a null doc_id is a row like any other; repeated rows
repeat their matches; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

ERROR_RATE = 0.08
#: Item text that one broadcast carries; more items are searched block by block.
BLOCK_CHARS = 4_000_000
#: Hits of one item on diagonals this close are verified together.
DIAGONALS = 32

SCHEMA = "doc_id long, item_id long, distance int, match_start long, match_end long"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces of near-equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text`` and where that substring ends first."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~((eq | minus) | up) & full, up & (eq | minus)
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """All items of one block: the automaton of their pieces, and the verification of hits."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items = [(k, t) for k, t in ((k, normalise(t)) for k, t in items) if t]
        self.errors = [budget(t, rate) for _, t in self.items]
        self.masks = [letter_masks(t) for _, t in self.items]
        self.backward = [letter_masks(t[::-1]) for _, t in self.items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, self.errors[n]):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) in the normalised text, for each item that matches."""
        if not self.items or not text:
            return []
        text = normalise(text)
        spots: set[tuple[int, int]] = set()
        for last, (length, where) in self.automaton.iter(text):
            for n, at in where:
                spots.add((n, (last + 1 - length - at) // DIAGONALS))
        found: dict[int, tuple[int, int, int]] = {}
        for n, spot in sorted(spots):
            item, errors = self.items[n][1], self.errors[n]
            low = max(0, spot * DIAGONALS - errors)
            high = spot * DIAGONALS + DIAGONALS + len(item) + errors
            exact = text.find(item, low, high)
            if exact >= 0:
                match = (0, exact, exact + len(item))
            else:
                part = text[low:high]
                distance, end = best_match(self.masks[n], len(item), part)
                if distance > errors:
                    continue
                # the same search backwards from the end gives the shortest start
                _, back = best_match(self.backward[n], len(item), part[:end][::-1])
                match = (distance, low + end - back, low + end)
            if n not in found or match < found[n]:
                found[n] = match
        by_item: dict[int, tuple[int, int, int]] = {}
        for n, match in found.items():
            item_id = self.items[n][0]
            if item_id not in by_item or match < by_item[item_id]:
                by_item[item_id] = match
        return sorted(((k, *v) for k, v in by_item.items()), key=lambda m: (m[0] is None, m[0] or 0))


def _search(shared, rate: float, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in sliced(batches):
            rows = [(at, *match) for at, text in enumerate(batch.column(1).to_pylist()) for match in matcher(text)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            whose = pa.array(columns[0], pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            found = [pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]
            own = [batch.column(2 + k).take(whose) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(whose), *found, *own], names=["doc_id", "item_id", "distance", "match_start", "match_end", *keep]
            )

    return run


def _blocks(items: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    out: list[list[tuple[int, str]]] = []
    room = 0
    for item in items:
        if room < len(item[1]) or not out:
            out.append([])
            room = BLOCK_CHARS
        out[-1].append(item)
        room -= len(item[1])
    return out


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end): places are code points of the normalised text; then the columns ``keep`` of the document's row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *keep)
    kinds = dict(docs.dtypes)
    schema = ", ".join([SCHEMA, *[f"`{k}` {kinds[k]}" for k in keep]])
    items = [
        (r["k"], r["t"])
        for r in benchmark.select(F.col(item_key).cast("long").alias("k"), F.col(item_text).alias("t"))
        .filter("t is not null").orderBy("k", "t").toLocalIterator()
    ]
    if not items:
        return spark.createDataFrame([], schema)
    found = [rows.mapInArrow(_search(spark.sparkContext.broadcast(b), rate, list(keep)), schema) for b in _blocks(items)]
    return reduce(DataFrame.unionByName, found)
