"""Packing token sequences into fixed windows by a non-negative least-squares plan.

Each document is its token ids and one end id.  Whole windows are cut off
first.  The rest of a document has 1 to ``WINDOW - 1`` ids; rests are counted
in a histogram of ``UNIT``-sized length bins, which has at most
``WINDOW / UNIT`` bins whatever the data.  Shallow combinations of two or
three bins that fill the window are enumerated, their repeat counts solved
against the histogram by non-negative least squares, rounded down, and
greedily raised while rests are left.  A planned sequence holds its two or
three rests; what exceeds the window (under ``DEPTH * UNIT`` ids) is cut off
the last.  All residuals are packed greedily, one after another, and cut
where a window is full, so only the last sequence is padded.

Defined results: a null text is the empty text (the end id alone); a null
doc_id is a row like any other; repeated rows are packed one by one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_count, materialize, sliced, with_rank
from .piece_cache import PieceCache

WINDOW, UNIT, DEPTH, END_ID = 2048, 16, 3, 1
#: Distinct pieces whose ids a worker keeps, in each of two generations.
CACHE_ROOM = 200_000
#: ASCII punctuation but for the apostrophe, which contractions begin with.
_TAIL = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Words of lower-case ASCII and Latin-1 letters, in UTF-8: one token run, and unchanged by normalisation.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Texts whose ids must be those of their pieces, else whole texts are given to the tokenizer;
#: and words on which the direct way must agree with it before it is taken.
_TEXTS = [b"Two  words", b"a\tb\nc d, e.", b"Hello, World! (x) ...", "na\u00efve  STRASSE stra\u00dfe".encode(), b" lead", b"trail ", b"1,000.5 - x's"]
_PROBES = [b"a", b"word", b"packing", b"\xc3\x9fa", "\u00e9t\u00e9".encode(), "stra\u00dfe".encode(), b"thththth", "\u00f1o\u00f1\u00ff".encode()]


def _byte_alphabet() -> dict[int, int]:
    """Byte-level alphabet of BPE tokenizers: printable bytes stand for themselves, the others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


class Ids:
    """Token ids of whole texts as little-endian unsigned words of ``width`` bytes.

    A tokenizer that drops white space and case and never joins across white
    space gives a text the ids of its pieces; each distinct piece is encoded
    once.  Any other tokenizer is given whole texts.
    """

    def __init__(self, path: str, room: int = CACHE_ROOM):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.cache = PieceCache(self._encode, room)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code, self.alphabet = "HI"[self.width // 4], _byte_alphabet()
        try:
            self.direct = self._by_tokenizer(_PROBES) == [self._by_model(p) for p in _PROBES]
        except Exception:  # another kind of model
            self.direct = False
        self.whole = any(self._by_tokenizer([t])[0] != b"".join(self._encode(self._split(t))) for t in _TEXTS)

    def _by_tokenizer(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _by_model(self, piece: bytes) -> bytes:
        """A plain word's ids from the merges alone, without the tokenizer's normalising, splitting and offsets."""
        tokens = self.tokenizer.model.tokenize(piece.decode("latin-1").translate(self.alphabet))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        if not self.direct:
            return self._by_tokenizer(pieces)
        plain = [_PLAIN.fullmatch(p) is not None for p in pieces]
        rest = iter(self._by_tokenizer([p for p, simple in zip(pieces, plain, strict=True) if not simple]))
        return [self._by_model(p) if simple else next(rest) for p, simple in zip(pieces, plain, strict=True)]

    def _split(self, text: bytes) -> list[bytes]:
        if any(s in text.lower() for s in self.specials):
            return text.split()
        # closing punctuation after an ASCII letter or digit is always a token run of its own
        out = []
        for piece in text.lower().split():
            body = piece.rstrip(_TAIL)
            if len(body) < len(piece) and body and body[-1:].isalnum():
                out += (body, piece[len(body) :])
            else:
                out.append(piece)
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            if self.whole:
                out += self._by_tokenizer(texts[at : at + 256])
                continue
            split = [self._split(t) for t in texts[at : at + 256]]
            self.cache.prepare({p for pieces in split for p in pieces})
            out += [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]
        return out


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One tokenizer and cache for each worker process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def _tokenise(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        end = np.array([end_id], ids.kind).tobytes()
        for batch in sliced(batches):
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), 1024):
                found = [x + end for x in ids(texts[at : at + 1024])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(found)),
                        pa.array([len(x) // ids.width for x in found], pa.int64()),
                        pa.array(found, pa.binary()),
                    ],
                    names=["doc_id", "n", "ids"],
                )

    return run


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Ascending bins, two to ``depth`` of them, that sum to ``units``."""
    out: list[tuple[int, ...]] = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if len(head) >= 1 and left >= head[-1]:
            out.append((*head, left))
        if len(head) + 2 <= depth:
            for x in range(head[-1] if head else 1, left // 2 + 1):
                grow((*head, x), left - x)

    grow((), units)
    return sorted(set(out))


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with the least ||a x - b||, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, right = a.T @ a, a.T @ b
    gain = right - gram @ x
    limit = 1e-8 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        if passive.all() or gain[~passive].max() <= limit:
            break
        passive[np.where(passive, -np.inf, gain).argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if trial[passive].min() > 0:
                break
            low = passive & (trial <= 0)
            step = (x[low] / np.maximum(x[low] - trial[low], 1e-300)).min()
            x = x + step * (trial - x)
            passive &= x > 1e-9
            x[~passive] = 0
            if not passive.any():
                break
        if passive.any():
            x = trial
        gain = right - gram @ x
    return x


def plan(histogram: dict[int, int], units: int = WINDOW // UNIT) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): never more rests of a bin than the histogram has."""
    have = np.array([histogram.get(q, 0) for q in range(units)], np.int64)
    ways = [c for c in combinations(units) if all(have[q] >= c.count(q) for q in c)]
    if not ways:
        return []
    matrix = np.zeros((units, len(ways)))
    for k, c in enumerate(ways):
        for q in c:
            matrix[q, k] += 1
    scale = max(1.0, float(have[1:].max()))
    solved = non_negative_least_squares(matrix[1:], have[1:] / scale) * scale
    repeats = np.floor(solved + 1e-6).astype(np.int64)
    left = have.copy()
    out: dict[int, int] = {}
    for greedy in (False, True):
        for k in sorted(range(len(ways)), key=lambda i: (-solved[i], ways[i])):
            need = {q: ways[k].count(q) for q in ways[k]}
            most = min(int(left[q]) // times for q, times in need.items())
            take = most if greedy else min(most, int(repeats[k]))
            if take > 0:
                out[k] = out.get(k, 0) + take
                for q, times in need.items():
                    left[q] -= take * times
    return [(ways[k], n) for k, n in sorted(out.items())]


def _with_running_sum(df: DataFrame, value: str, order: list[Column], buckets: int, out: str) -> DataFrame:
    """Exclusive running sum over all rows in (bucket, order): sums inside buckets, plus a bounded table of bucket sums."""
    df = df.withColumn("__bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    sums = df.groupBy("__bucket").agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = df.join(F.broadcast(offsets), F.col("__bucket") == F.col("__b"))  # at most 1024 rows
    return joined.withColumn(out, F.col("__own") + F.col("__before")).drop("__bucket", "__b", "__before", "__own")


def _digest(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """CRC and rows of the pieces of each document."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: list[list] = [[] for _ in names]
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for doc, n, ids, pieces in rows:
                words = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for p in sorted(pieces, key=lambda p: p["start"]):
                    part = words[p["start"] : p["start"] + p["length"]]
                    for c, v in zip(columns, (doc, p["start"], p["length"], zlib.crc32(part.tobytes()), n, p["sequence_id"], p["offset"]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = rows.mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, n long, ids binary")
    # written once: the row number stays what it is, and nothing is tokenised again
    tokens = materialize(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    lengths = tokens.select("uid", "n").withColumns({
        "windows": F.floor(F.col("n") / WINDOW).cast("long"), "rest": F.pmod("n", F.lit(WINDOW)).cast("long"),
    })
    bin_of = F.floor(F.col("rest") / UNIT).cast("int")
    total = lengths.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("windows"), F.lit(0)).alias("windows")).first()
    histogram = dict(lengths.filter("rest > 0").groupBy(bin_of.alias("q")).count().collect())  # WINDOW / UNIT rows at most

    planned = plan(histogram)
    used: dict[int, int] = {}
    places, first = [], 0
    for combination, repeats in planned:
        for part, q in enumerate(combination):
            at = used.get(q, 0)
            places.append((q, at, at + repeats, first, part))
            used[q] = at + repeats
        first += repeats
    lot = spark.createDataFrame(places, "__q int, __from long, __to long, __first long, part int")

    rests = lengths.filter("rest > 0").select("uid", "n", "rest", bin_of.alias("q"))
    bucket = F.pmod(F.xxhash64("uid"), F.lit(bucket_count(total["rows"], 1)))
    ranked = with_rank(rests, "q", [F.col("uid")], bucket, "rank")
    # the plan has at most one row for each bin of each combination with repeats
    dealt = ranked.join(
        F.broadcast(lot), (F.col("q") == F.col("__q")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to")), "left"
    ).select(
        "uid", (F.col("n") - F.col("rest")).alias("start"), F.col("rest").alias("length"),
        (F.col("__first") + F.col("rank") - F.col("__from")).alias("sequence_id"), "part",
    )
    # dealt feeds both the planned sequences and the residuals
    dealt = materialize(dealt, "dealt")
    inside = Window.partitionBy("sequence_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.filter("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    keep = F.least(F.col("length"), F.lit(WINDOW) - F.col("offset"))
    placed = placed.withColumn("keep", keep)
    in_plan = placed.select("uid", "start", F.col("keep").alias("length"), "sequence_id", "offset")

    cut_off = placed.filter("length > keep").select(
        "uid", (F.col("start") + F.col("keep")).alias("start"), (F.col("length") - F.col("keep")).alias("length")
    )
    residual = dealt.filter("sequence_id is null").select("uid", "start", "length").unionByName(cut_off)
    buckets = bucket_count(total["rows"], 1)
    stream = _with_running_sum(residual, "length", [F.col("uid"), F.col("start")], buckets, "at")
    windows = F.sequence(F.floor(F.col("at") / WINDOW), F.floor((F.col("at") + F.col("length") - 1) / WINDOW))
    cut = stream.select("uid", "start", "length", "at", F.explode(windows).alias("w"))
    low = F.greatest(F.col("at"), F.col("w") * WINDOW)
    high = F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * WINDOW)
    in_stream = cut.select(
        "uid", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
        (F.lit(first + total["windows"]) + F.col("w")).alias("sequence_id"), (low - F.col("w") * WINDOW).alias("offset"),
    )

    full = _with_running_sum(lengths.filter("windows > 0"), "windows", [F.col("uid")], buckets, "at")
    full = full.select("uid", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("k")).select(
        "uid", (F.col("k") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("length"),
        (F.lit(first) + F.col("at") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    fields = ["start", "length", "sequence_id", "offset"]
    pieces = full.unionByName(in_plan).unionByName(in_stream)
    pieces = pieces.groupBy(F.col("uid").alias("__uid")).agg(
        F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in fields])).alias("pieces")
    )
    width = ids_of(tokenizer_path).width
    return tokens.join(pieces, F.col("uid") == F.col("__uid")).select("doc_id", "n", "ids", "pieces").mapInArrow(
        _digest(width), ", ".join(f"{c} long" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    )
