"""Toxicity by a learned lexicon, fuzzy term matching and context windows.

Fitting reads a bounded sample of labelled rows (``MAX_LABELLED``, those with
the least hash of doc_id).  Terms are whole words, and word stems, that
nearly all of the sampled documents which have them are toxic.  Whole words
go into a trie; a Levenshtein automaton for one edit, made deterministic as
it is used, is intersected with the trie, so every token within one edit of
a whole word is found without comparing it to each.  Sampled documents also tell
which misspelled forms are ordinary words: those get their own weight.  Terms and
forms are bounded by the sample alone.

Scoring finds the terms of a whole text with their places.  A term between
quotation marks, or shortly after a reporting word, is a quotation and is
kept apart from abuse.  The features are sums, the strongest window and the
density of the weights; a logistic regression turns them into a score.

Defined results: null and empty texts score like any text without terms; a
null doc_id is in no fold (held_out false) and never used for fitting; with
no labelled toxic document the score is the sample's share of toxic ones;
repeated rows score alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

#: Labelled rows that fitting reads at most: the bound of all that it gathers.
MAX_LABELLED = 20_000
#: Entries that a task counts before it hands them on.
MOST_COUNTED = 200_000
THRESHOLD = 0.7
STEM_LENGTHS = range(4, 9)
FUZZY_LENGTH, FUZZY_SHARE = 5, 0.5
WINDOW, QUOTE_REACH = 12, 8
LEAST_PRECISION = 0.85
#: Words that report speech, and quotation marks.
REPORTING = frozenset("said says say quote quoted quotes called wrote term word phrase slur dit sagte sagt dijo dice citation zitat cita".split())
QUOTES = re.compile("[\"“”„«»]")
TOKEN = re.compile(r"[^\W_]+")


def folds(key: Column) -> Column:
    """crc32 of the key's text modulo 3; remainder 1 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 3


class FuzzyTrie:
    """One-edit Levenshtein automata over a trie of terms, determinised lazily."""

    MOST_STATES = 200_000

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(set(terms)):
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = t
        self.start = self._closed({0: 0})
        self.steps: dict[tuple[frozenset, str], frozenset] = {}

    def _closed(self, edits: dict[int, int]) -> frozenset:
        """Skipping a letter of the term costs an edit and reads nothing."""
        for node, spent in list(edits.items()):
            if spent == 0:
                for child in self.children[node].values():
                    edits.setdefault(child, 1)
        return frozenset(edits.items())

    def _step(self, state: frozenset, c: str) -> frozenset:
        known = self.steps.get((state, c))
        if known is None:
            edits: dict[int, int] = {}

            def reach(node: int, spent: int) -> None:
                if spent < edits.get(node, 2):
                    edits[node] = spent

            for node, spent in state:
                child = self.children[node].get(c)
                if child is not None:
                    reach(child, spent)
                if spent == 0:
                    reach(node, 1)
                    for other in self.children[node].values():
                        reach(other, 1)
            if len(self.steps) >= self.MOST_STATES:
                self.steps.clear()
            known = self.steps[state, c] = self._closed(edits)
        return known

    def reaches(self, prefix: str) -> bool:
        state = self.start
        for c in prefix:
            state = self._step(state, c)
        return bool(state)

    def match(self, token: str) -> list[tuple[str, int]]:
        """Terms within one edit of the token, with the edits."""
        state = self.start
        for c in token:
            state = self._step(state, c)
            if not state:
                return []
        return sorted((self.term[node], spent) for node, spent in state if self.term[node] is not None)


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    forms: dict[str, float] = field(default_factory=dict)  # weights of misspelled forms seen while fitting


class Finder:
    """Weighted hits of a lexicon in a text."""

    MOST_TOKENS = 200_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.trie = FuzzyTrie([w for w in lexicon.words if len(w) >= FUZZY_LENGTH])
        self.short = {w[:3] for w in lexicon.words} | {s[:3] for s in lexicon.stems}
        self.alive: dict[str, bool] = {}
        self.known: dict[str, tuple[float, bool]] = {}

    def _weigh(self, token: str) -> tuple[float, bool]:
        """(weight, misspelled) of a token; weight 0: no term."""
        own = self.lexicon.words.get(token)
        if own is not None:
            return own, False
        stem = max((self.lexicon.stems.get(token[:n], 0.0) for n in STEM_LENGTHS), default=0.0)
        if stem > 0:
            return stem, False
        if token in self.lexicon.forms:
            return self.lexicon.forms[token], True
        if len(token) >= FUZZY_LENGTH - 1 and token.isalnum():
            near = [self.lexicon.words[t] for t, _ in self.trie.match(token)]
            if near:
                return FUZZY_SHARE * max(near), True
        return 0.0, False

    def weigh(self, token: str) -> tuple[float, bool]:
        head = token[:3]
        open_ = self.alive.get(head)
        if open_ is None:
            open_ = self.alive[head] = head in self.short or self.trie.reaches(head)
        if not open_:
            return 0.0, False
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.MOST_TOKENS:
                self.known.clear()
            found = self.known[token] = self._weigh(token)
        return found

    def hits(self, text: str) -> tuple[list[tuple[int, float, bool, bool, str]], int]:
        """(place, weight, misspelled, quoted, token) of each hit, and the number of tokens."""
        lowered = text.lower()
        tokens = TOKEN.findall(lowered)
        alive = self.alive
        found = []
        for i, t in enumerate(tokens):
            if alive.get(t[:3], True):
                weight, misspelled = self.weigh(t)
                if weight:
                    found.append((i, weight, misspelled, t))
        if not found:
            return [], len(tokens)
        inside = self._quoted(lowered) if QUOTES.search(lowered) else frozenset()
        return [
            (i, w, m, i in inside or any(t in REPORTING for t in tokens[max(0, i - 3) : i]), token)
            for i, w, m, token in found
        ], len(tokens)

    @staticmethod
    def _quoted(text: str) -> set[int]:
        """Places of the tokens inside short quotations."""
        marks, out, last = [m.start() for m in QUOTES.finditer(text)], set(), None
        starts = [m.start() for m in TOKEN.finditer(text)]
        at = np.searchsorted(starts, marks)
        for place in at:
            if last is not None and 0 < place - last <= QUOTE_REACH:
                out.update(range(last, place))
                last = None
            else:
                last = place
        return out


def features(finder: Finder, text: str) -> list[float]:
    hits, n = finder.hits(text)
    plain = [(i, w, m) for i, w, m, q, _ in hits if not q]
    exact = sum(w for _, w, m in plain if not m)
    fuzzy = sum(w for _, w, m in plain if m)
    quoted = sum(w for _, w, _, q, _ in hits if q)
    strongest, left, running = 0.0, 0, 0.0
    for i, w, _ in plain:
        running += w
        while plain[left][0] < i - WINDOW:
            running -= plain[left][1]
            left += 1
        strongest = max(strongest, running)
    total = exact + fuzzy
    return [
        math.log1p(max(0.0, total)), max((w for _, w, _ in plain), default=0.0), strongest,
        math.log1p(1000.0 * max(0.0, total) / (n + 20.0)), math.log1p(max(0.0, quoted)), 1.0 if total > 0 else 0.0,
    ]


@dataclass
class Model:
    lexicon: Lexicon
    centre: list[float]
    spread: list[float]
    coefficients: list[float]
    bias: float

    def score(self, finder: Finder, text: str) -> float:
        z = self.bias + sum(
            c * (x - m) / s for c, x, m, s in zip(self.coefficients, features(finder, text), self.centre, self.spread, strict=True)
        )
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1.0)) - math.log((clean + 0.5) / (n_clean + 1.0))


def _entries(text: str | None) -> set[str]:
    """Words of a text, and their stems, which end in an asterisk."""
    words = set(TOKEN.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


def _counted(counts: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
    """What was counted so far, as rows; the counters are empty afterwards."""
    for toxic, found in enumerate(counts):
        items = list(found.items())
        found.clear()
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([v for _, v in part], pa.int64())],
                names=["entry", "toxic", "n"],
            )


def _count(wanted: set[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _entries(text)
                counts[toxic].update(own if wanted is None else own & wanted)
                if len(counts[0]) + len(counts[1]) > MOST_COUNTED:
                    yield from _counted(counts)
        yield from _counted(counts)

    return run


def _choose(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    """Precise entries; of entries that stand for the same documents, the longest stem or the whole word."""
    lexicon = Lexicon()
    weights = {
        k: _log_odds(t, c, n_toxic, n_clean) for k, (t, c) in counts.items() if t / (t + c) >= LEAST_PRECISION
    }
    in_order = sorted(weights)

    def longest(body: str) -> int:
        """Most toxic documents of an entry that extends the stem."""
        most, at = 0, bisect_left(in_order, body)
        while at < len(in_order) and in_order[at].startswith(body):
            if in_order[at] != body + "*":
                most = max(most, counts[in_order[at]][0])
            at += 1
        return most

    for k, w in sorted(weights.items(), key=lambda x: (-counts[x[0]][0], x[0])):
        have, body = counts[k][0], k.rstrip("*")
        if k.endswith("*"):
            if longest(body) < 0.9 * have:
                lexicon.stems[body] = w
        else:
            stems = [counts[body[:n] + "*"][0] for n in STEM_LENGTHS if len(body) > n and body[:n] in lexicon.stems]
            if not stems or have >= 0.5 * max(stems):
                lexicon.words[k] = w
    return lexicon


def _collect_features(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(lexicon)
        for batch in sliced(batches):
            rows = [features(finder, t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    return run


def _collect_forms(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, counts = Finder(lexicon), (Counter(), Counter())
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({t for _, _, m, _, t in finder.hits(text or "")[0] if m})
                if len(counts[0]) + len(counts[1]) > MOST_COUNTED:
                    yield from _counted(counts)
        yield from _counted(counts)

    return run


def _both(counted: DataFrame, least: int, precision: float = 0.0) -> dict[str, tuple[int, int]]:
    """(toxic, clean) by entry: entries of at least ``least`` documents, a share of ``precision`` of them toxic."""
    summed = counted.groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"),
    )
    share = F.col("t") / (F.col("t") + F.col("c"))
    rows = summed.filter((F.col("t") + F.col("c") >= least) & (share >= precision)).collect()
    return {r["entry"]: (r["t"], r["c"]) for r in rows}


def _regress(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[list[float], list[float], list[float], float]:
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - centre) / spread])
    ridge = np.diag([1e-3] + [penalty] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return centre.tolist(), spread.tolist(), w[1:].tolist(), float(w[0])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from at most ``MAX_LABELLED`` labelled rows outside the held-out fold."""
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).cast("int").alias("toxic"))
    known = known.filter("k is not null and toxic in (0, 1)").filter(folds(F.col("k")) != 1)
    chosen = known.groupBy("k").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(MAX_LABELLED)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text"))
    # the sample of ids has at most MAX_LABELLED rows
    sample = materialize(rows.join(F.broadcast(chosen), "k").select("text", "toxic"), "labelled")
    totals = dict(sample.groupBy("toxic").count().collect())
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon()
    counted = "entry string, toxic int, n long"
    if n_toxic:
        least = max(3, round(0.004 * n_toxic))
        frequent = _both(sample.filter("toxic = 1").mapInArrow(_count(None), counted), least)
        both = _both(sample.mapInArrow(_count(set(frequent)), counted), least, LEAST_PRECISION)
        lexicon = _choose({k: v for k, v in both.items() if v[0] >= least}, n_toxic, n_clean)
        forms = _both(sample.mapInArrow(_collect_forms(lexicon), counted), 1)
        lexicon.forms = {
            k: min(FUZZY_SHARE * max(lexicon.words.values(), default=0.0), max(0.0, _log_odds(t, c, n_toxic, n_clean)))
            for k, (t, c) in forms.items()
        }
    seen = sample.mapInArrow(_collect_features(lexicon), "x array<double>, toxic int").collect()
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(lexicon, [0.0] * 6, [1.0] * 6, [0.0] * 6, math.log(share / (1 - share)))
    x, y = np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float)
    return Model(lexicon, *_regress(x, y))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row and column of ``docs`` with held_out, score and predicted."""
    docs = docs.drop(*({"held_out", "score", "predicted"} & set(docs.columns)))
    position = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.lexicon)
        for batch in sliced(batches):
            scores = [model.score(finder, t or "") for t in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    held = F.coalesce(folds(F.col(key)) == 1, F.lit(False))
    return docs.mapInArrow(run, f"{fields}, score double").select(
        *docs.columns, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
