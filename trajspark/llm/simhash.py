"""SimHash near-duplicates through Gray-order hierarchical indexes.

Distinct fingerprints are sorted by Gray rank.  Runs of ``FAN`` of them are
the lowest nodes, runs of ``FAN`` nodes the nodes above.  A node holds the
masked bit pattern that all its members share, but for the bits that the nodes
above it share already: a search goes down from the root, adds up the
differences node by node, and prunes a whole group as soon as the sum is over
the limit.

The work is split by bits: fingerprints that differ in at most ``limit`` bits
agree in at least ``keep`` of ``limit + keep`` fixed blocks, so all links lie
inside the groups that share the leading bits of ``keep`` blocks.  How many
bits that are follows from the number of fingerprints (``GROUP`` to a group on
average; few fingerprints are one group).  Each group has an index of its own
and reports a spanning forest, not its pairs; crowded groups are cut into parts
that are compared pair by pair in tasks of their own.

:func:`near_duplicate_components` links fingerprints.
:func:`near_duplicate_classes` links texts: those that share a key of their
shingle sets are searched with the index, and what it leaves is compared as
whole sets; links are pairs of exact similarity ``least`` or more.

Defined results: a null text counts as empty; an empty text has fingerprint
zero, linked like any other (all empty texts are alike); rows with equal
fingerprints are linked at distance zero; a null doc_id is a row like any
other, and the smallest doc_id of a component passes nulls over (null only
where all are); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize, sliced
from .components import connected_components
from .shingles import band_keys, set_id, shingles, windows_of

MAX_BITS, SHINGLE, SEED = 4, 4, 42
FAN = 8
#: Fingerprints aimed at for a group; groups with more than GROUP_LIMIT are cut into parts.
GROUP, GROUP_LIMIT = 4_096, 50_000
#: Rows of groups aimed at for a task, and most tasks.
TASK_ROWS, MOST_TASKS = 1 << 15, 20_000
#: Places of queries searched together times fingerprints, and pairs of query and node looked at together.
QUERIES, PIECE = 1 << 22, 1 << 16
#: Texts as sets: words of a shingle, least similarity, differing bits beyond which no set is compared (of pairs at
#: similarity 0.8 one in a million differs in more), and shingles to a part of a crowded group.
SET_SHINGLE, LEAST, SET_BITS, PART_SHINGLES = 5, 0.8, 24, 1 << 20


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        part = hashes[at : at + PIECE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the UTF-8 text: bits set in over half of its shingles' hashes."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxh64_intdigest(joined, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    first, last = [0, *ends[:-shingle]], ends[shingle - 1 :]
    hashes = (xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(first, last, strict=True))
    return majority(np.fromiter(hashes, np.uint64, len(last)))


def _fingerprints(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            known: dict[bytes, int] = {}
            out = np.empty(len(texts), np.uint64)
            for i, text in enumerate(texts):
                text = text or b""
                found = known.get(text)
                if found is None:
                    found = known[text] = fingerprint(text, shingle)
                out[i] = found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint's bits as a signed long."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each word in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes of shared masked bit patterns.

    ``levels`` go from the root to the members; each is (pattern, mask) of the
    bits that a node adds to those of the nodes above it.  ``looked`` and
    ``pruned`` count pairs of a query and a node.
    """

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(gray_rank(words), kind="stable")
        self.words = words[self.order]
        shared = [(self.words, np.full(len(words), ~np.uint64(0)))]
        ones = zeros = self.words
        while len(ones) > 1:
            starts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(zeros, starts)
            shared.append((ones, ~(ones ^ zeros)))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.zeros(1, np.uint64)
        for pattern, mask in reversed(shared):
            own = mask & ~above.repeat(FAN)[: len(mask)]
            self.levels.append((pattern & own, own))
            above = mask
        self.looked = self.pruned = 0

    def _alike(self, labels: np.ndarray) -> list[np.ndarray]:
        """For the nodes of each level the label that all their members have, or -1."""
        out = [labels]
        low = high = labels
        while len(low) > 1:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def pairs(self, limit: int, labels: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of pairs within the limit whose labels differ, i < j, in bounded pieces.

        The labels are asked for again for each lot of queries: a pair of one label, as far as known, is passed over.
        """
        n, depth = len(self.words), len(self.levels)
        step = max(1, QUERIES // max(n, 1))
        for first in range(0, n, step):
            own = labels()
            alike = self._alike(own)
            q = np.arange(first, min(n, first + step))
            stack = [(0, q, np.zeros(len(q), np.int64), np.zeros(len(q), np.uint8))]
            while stack:
                level, q, node, so_far = stack.pop()
                if len(q) > PIECE:
                    stack += [(level, q[a : a + PIECE], node[a : a + PIECE], so_far[a : a + PIECE]) for a in range(0, len(q), PIECE)]
                    continue
                pattern, mask = self.levels[level]
                so_far = so_far + np.bitwise_count((self.words[q] ^ pattern[node]) & mask[node])
                last = (node + 1) * FAN ** (depth - 1 - level) - 1
                live = (so_far <= limit) & (last > q) & (alike[level][node] != own[q])
                self.looked += len(q)
                self.pruned += len(q) - int(np.count_nonzero(live))
                q, node, so_far = q[live], node[live], so_far[live]
                if not len(q):
                    continue
                if level == depth - 1:
                    yield q, node
                    continue
                below = (node[:, None] * FAN + np.arange(FAN)).ravel()
                inside = below < len(self.levels[level + 1][0])
                stack.append((level + 1, q.repeat(FAN)[inside], below[inside], so_far.repeat(FAN)[inside]))


class Forest:
    """Union-find over places; the root is the smallest place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            roots = self.roots()
            x, y = roots[a], roots[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])

    def moved(self) -> tuple[np.ndarray, np.ndarray]:
        """Places that are not roots, and their roots."""
        roots = self.roots()
        places = np.nonzero(roots != np.arange(len(roots)))[0]
        return places, roots[places]


def links(words: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of distinct words linked at ``limit`` bits: (word, first word of its tree in Gray order)."""
    index, forest = GrayIndex(words), Forest(len(words))
    for i, j in index.pairs(limit, forest.roots):
        forest.join(i, j)
    places, roots = forest.moved()
    return index.words[places], index.words[roots]


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition that is sorted by its first ``keys`` columns, cut between groups: no group spans two batches."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        cuts = _cuts(batch, keys)
        if held is not None:
            head = pa.Table.from_batches([b.slice(b.num_rows - 1) for b in held.to_batches()[-1:]] + [batch.slice(0, 1)]).combine_chunks()
            if len(_cuts(head.to_batches()[0], keys)) == 1:  # the held group goes on
                if len(cuts) == 1:
                    held = pa.concat_tables([held, own])
                    continue
                held = pa.concat_tables([held, own.slice(0, cuts[1])])
                cuts = cuts[1:]
            yield from held.combine_chunks().to_batches()
        if cuts[-1] > cuts[0]:
            yield batch.slice(cuts[0], cuts[-1] - cuts[0])
        held = own.slice(cuts[-1])
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _cuts(batch: pa.RecordBatch, keys: int) -> list[int]:
    """First rows of the groups."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(keys):
        new |= np.diff(batch.column(k).to_numpy(zero_copy_only=False)) != 0
    return [0, *(np.nonzero(new)[0] + 1).tolist()]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u, v = (np.concatenate([x[k] for x in found]).astype(np.uint64, copy=False).view(np.int64) for k in range(2))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _group_links(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 3):
            words = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [*_cuts(batch, 3), len(words)]
            found = [links(np.unique(words[a:b]), limit) for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1]
            if found:
                yield _edges(found)

    return run


def split_masks(fingerprints: int, limit: int) -> list[int]:
    """Bit masks, one for each choice of blocks: fingerprints within the limit agree under at least one of them."""
    bits = max(0, (max(1, -(-fingerprints // GROUP)) - 1).bit_length())
    keep = 0
    while keep * (64 // (limit + keep) if keep else 0) < bits and keep < 4:
        keep += 1
    blocks = limit + keep
    if not keep:
        return [0]
    width = min(64 // blocks, -(-bits // keep))
    starts = [64 * b // blocks for b in range(blocks)]
    return [sum(((1 << width) - 1) << s for s in chosen) for chosen in combinations(starts, keep)]


def _parts(n: Column, each: int, key: str) -> Column:
    """The sub-groups of a row: pairs of parts of its group, which has one part for ``each`` of its ``n``."""
    parts = F.ceil(n / F.lit(each)).cast("int")
    own = F.pmod(F.xxhash64(key), parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda t: F.least(own, t) * parts + F.greatest(own, t))


def near_links(distinct: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that span the components of the distinct fingerprints in column fp."""
    n = distinct.count()
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in split_masks(n, limit)]
    combos = [F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for k, m in enumerate(masks)]
    keyed = distinct.select("fp", F.explode(F.array(*combos)).alias("k")).select("k.combo", "k.shared", "fp")
    crowded = keyed.groupBy("combo", "shared").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > GROUP_LIMIT)
    crowded = materialize(crowded, "simhash-crowded")
    whole = F.array(F.lit(0))
    if crowded.isEmpty():
        grouped = keyed.select("combo", "shared", F.lit(0).alias("sub"), "fp")
    else:
        keyed = keyed.join(crowded, ["combo", "shared"], "left")
        sub = F.when(F.col("__n").isNull(), whole).otherwise(_parts(F.col("__n"), GROUP_LIMIT, "fp"))
        grouped = keyed.select("combo", "shared", F.explode(sub).alias("sub"), "fp")
    tasks = max(1, min(MOST_TASKS, n * len(masks) // TASK_ROWS))  # as many as the work is, however few bytes it has
    placed = grouped.repartition(tasks, "combo", "shared", "sub").sortWithinPartitions("combo", "shared", "sub")
    return placed.select("combo", "shared", "sub", "fp").mapInArrow(_group_links(limit), "u long, v long")


def near_duplicate_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, limit: int = MAX_BITS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row; component_id is the smallest doc_id reachable over links."""
    rows = materialize(fingerprints(docs, key, text, shingle), "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(near_links(nodes.select("fp"), limit))
    named = nodes.join(roots, nodes["fp"] == roots["vertex"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named, "simhash-nodes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# texts linked by the similarity of their shingle sets


def _described(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "text_hash", "node", "fp", "size", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(shingle)
        for batch in sliced(batches):
            nodes, fps, sizes, bands = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                own = shingles(text or b"", windows)
                nodes.append(set_id(own))
                fps.append(majority(own))
                sizes.append(len(own))
                bands.append(band_keys(own))
            if not nodes:
                continue
            keys = np.concatenate(bands).view(np.int64)
            ends = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * len(bands[0]))
            columns = [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)), pa.array(sizes, pa.int32())]
            columns.append(pa.ListArray.from_arrays(ends, pa.array(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return run


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member of a group the group's centre: the member that differs least from the majority of their bits."""
    for batch in _runs(batches, 2):
        nodes, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        fps = fps.view(np.uint64)
        cuts = np.array(_cuts(batch, 2))
        sizes = np.diff(cuts, append=len(nodes))
        centre = np.empty(len(cuts), np.int64)
        for at in range(0, len(cuts), 4096):
            a, b = cuts[at], (cuts[at + 4096] if at + 4096 < len(cuts) else len(nodes))
            own = cuts[at : at + 4096] - a
            bits = np.unpackbits(fps[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, own, axis=0, dtype=np.int32)
            n = sizes[at : at + 4096]
            middle = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            apart = np.bitwise_count(fps[a:b] ^ middle.repeat(n)).astype(np.int64) << 40
            centre[at : at + 4096] = np.minimum.reduceat(apart + np.arange(a, b), own) & ((1 << 40) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[centre].repeat(sizes)), pa.array(nodes)], names=["centre", "node"])


def _sets(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = windows_of(shingle)
        for batch in sliced(batches, 256):
            sets = [shingles(t or b"", windows) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            nodes = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            values = pa.array(np.concatenate(sets or [np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(ends, values)], names=["node", "shingles"])

    return run


def set_links(fps: np.ndarray, values: np.ndarray, ends: np.ndarray, least: float, limit: int = SET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of sets of similarity ``least`` or more: (place, root's place).

    The index gives the pairs that may be alike and are in different trees so
    far; a query's shingles are marked, and the marks under each candidate
    counted: no pair is written anywhere.
    """
    index, forest = GrayIndex(fps), Forest(len(fps))
    _, ids = np.unique(values, return_inverse=True)
    marked = np.zeros(int(ids.max(initial=0)) + 1, bool)
    sizes = np.diff(ends)
    for i, j in index.pairs(limit, lambda: forest.roots()[index.order]):
        queries, candidates = index.order[i], index.order[j]
        a, b = sizes[queries], sizes[candidates]
        close = np.minimum(a, b) >= least * np.maximum(a, b)
        queries, candidates = queries[close], candidates[close]
        if not len(queries):
            continue
        at = np.argsort(queries, kind="stable")
        queries, candidates = queries[at], candidates[at]
        first = np.nonzero(np.diff(queries, prepend=-1))[0]
        for lo, hi in zip(first, [*first[1:], len(queries)], strict=True):
            q, other = queries[lo], candidates[lo:hi]
            roots = forest.roots()
            other = other[roots[other] != roots[q]]
            if not len(other):
                continue
            n = sizes[other]
            before = np.cumsum(n) - n
            marked[ids[ends[q] : ends[q + 1]]] = True
            under = marked[ids[np.arange(n.sum()) + np.repeat(ends[other] - before, n)]]
            shared = np.add.reduceat(under, before, dtype=np.int64)
            marked[ids[ends[q] : ends[q + 1]]] = False
            alike = other[shared >= least * (sizes[q] + n - shared)]
            forest.join(alike, np.full(len(alike), q))
    return forest.moved()


def _set_group_links(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _runs(batches, 2):
            nodes, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            lists = batch.column(4)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            found = []
            cuts = [*_cuts(batch, 2), len(nodes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a + 1:
                    u, v = set_links(fps[a:b].view(np.uint64), values[ends[a] : ends[b]], ends[a : b + 1] - ends[a], least)
                    found.append((nodes[a:b][u], nodes[a:b][v]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in range(2)], names=["u", "v"])

    return run


def near_duplicate_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SET_SHINGLE, least: float = LEAST,
) -> DataFrame:
    """(doc_id, text_hash, root) for each row: rows of one root are joined by links of alike texts."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = texts.select("doc_id", "text_hash", "text").mapInArrow(
        _described(shingle), "doc_id long, text_hash long, node long, fp long, size int, bands array<long>"
    )
    rows = materialize(rows, "near-rows")
    nodes = materialize(rows.select("node", "fp", "size", "bands").dropDuplicates(["node"]), "near-nodes")
    keyed = nodes.select("node", "fp", F.explode("bands").alias("k"))
    # keys of one set have no links: their rows do not go on
    counted = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(counted, "k").select("k", F.explode(_parts(F.col("n"), GROUP_LIMIT, "node")).alias("sub"), "node", "fp")
    placed = shared.repartition("k", "sub").sortWithinPartitions("k", "sub")
    # sets that share a key share its centre: groups of one centre hold all pairs, each set once
    members = materialize(placed.mapInArrow(_centred, "centre long, node long").distinct(), "near-members")
    sizes = members.join(nodes.select("node", "size"), "node").groupBy("centre").agg(F.sum("size").alias("n"))
    sizes = materialize(sizes, "near-sizes")

    wanted = members.select("node").distinct()
    known = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    own = texts.join(known, "text_hash", "left_semi").select("text").mapInArrow(_sets(shingle), "node long, shingles array<long>")
    own = own.dropDuplicates(["node"]).join(nodes.select("node", "fp"), "node")
    own = materialize(own, "near-sets")
    grouped = members.join(sizes, "centre").select("centre", F.explode(_parts(F.col("n"), PART_SHINGLES, "node")).alias("sub"), "node")
    grouped = grouped.join(own, "node").repartition("centre", "sub").sortWithinPartitions("centre", "sub")
    found = grouped.select("centre", "sub", "node", "fp", "shingles").mapInArrow(_set_group_links(least), "u long, v long")
    roots = connected_components(found)
    classes = nodes.select("node").join(roots, nodes["node"] == roots["vertex"], "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "text_hash", "node").join(classes, "node").select("doc_id", "text_hash", "root")
