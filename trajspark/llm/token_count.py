"""Unigram token counts by dynamic programming over a trie of pre-tokens.

Pre-tokens are the white-space-separated words of a text, each with a word
mark in front.  The vocabulary's pieces have ranks; a piece's score is minus
the logarithm of its rank (a Zipf estimate; no scores are trained).  A word's
tokens are those of its best-scoring segmentation (ties: fewer tokens);
characters outside the vocabulary fall back to one token for each UTF-8 byte.

The distinct words of a batch are inserted in a trie, which is walked from
its root: the forward score of a node is computed once for all words that
share its prefix, and each word's count is taken where it ends.

Defined results: null and empty texts have no words and no tokens; each row
is counted by itself, one with a null doc_id too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .piece_cache import PieceCache

MARK = "▁"
#: Distinct words whose counts a worker keeps, in each of two generations.
CACHE_ROOM = 500_000
#: Distinct words inserted in one trie.
TRIE_WORDS = 16_384
SCORE, ENDS = 0, 0  # key of a vocabulary node's score, and of the words that end in a node; children have one-character keys


class Vocabulary:
    """Pieces in a character trie, with scores from their ranks."""

    def __init__(self, pieces: list[str]):
        self.root: dict = {}
        self.byte_score = -math.log(len(pieces) + 2.0) - 1.0
        for rank, piece in enumerate(pieces):
            if not piece:
                continue
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node.setdefault(SCORE, -math.log(rank + 2.0))

    @classmethod
    def from_model(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a SentencePiece model file, in the order of their ids."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        return cls([model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))])

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word, trie by trie of at most ``TRIE_WORDS`` distinct words."""
        out: list[int] = []
        for at in range(0, len(words), TRIE_WORDS):
            out += self._trie_counts(words[at : at + TRIE_WORDS])
        return out

    def _trie_counts(self, words: list[str]) -> list[int]:
        """The words are inserted in a trie; each of its nodes is scored once, for all words that go through it."""
        top: dict = {}
        for k, word in enumerate(words):
            node = top
            for c in MARK + word:
                node = node.setdefault(c, {})
            node.setdefault(ENDS, []).append(k)
        root, byte_score = self.root, self.byte_score
        out = [0] * len(words)
        # along the path to the node in hand: best[j] = (score, -tokens) of its first j characters,
        # alive[j] = vocabulary nodes reached by text that ends at j, with the score where they began
        best: list[tuple[float, int]] = [(0.0, 0)]
        alive: list[list[tuple[dict, tuple[float, int]]]] = [[]]
        ahead = [(0, c, child) for c, child in top.items()]
        while ahead:
            j, c, node = ahead.pop()
            del best[j + 1 :], alive[j + 1 :]
            here, size = best[j], len(c.encode("utf-8", "surrogatepass"))
            most = (here[0] + byte_score * size, here[1] - size)
            reached = []
            for at, start in (*alive[j], (root, here)):
                child = at.get(c)
                if child is not None:
                    reached.append((child, start))
                    score = child.get(SCORE)
                    if score is not None:
                        found = (start[0] + score, start[1] - 1)
                        if found > most:
                            most = found
            best.append(most)
            alive.append(reached)
            for k in node.pop(ENDS, ()):
                out[k] = -most[1]
            ahead += [(j + 1, x, child) for x, child in node.items()]
        return out


_LOADED: dict[str, PieceCache] = {}


def _cache(path: str) -> PieceCache:
    if path not in _LOADED:
        _LOADED[path] = PieceCache(Vocabulary.from_model(path).counts, CACHE_ROOM)
    return _LOADED[path]


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch in sliced(batches):
            words, tokens = [], []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 1024):
                split = [(t or "").split() for t in texts[at : at + 1024]]
                cache.prepare({w for own in split for w in own})
                words += map(len, split)
                tokens += [sum(map(cache.__getitem__, own)) for own in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row; no shuffle."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_count(model_path), "doc_id long, n_words long, n_tokens long")
