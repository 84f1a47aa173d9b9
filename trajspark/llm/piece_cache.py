"""A bounded cache for what is computed once for each distinct piece of text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any


class PieceCache(dict):
    """Values by piece, in two generations of at most ``room`` pieces each.

    A full generation replaces the older one, so frequent pieces stay and
    memory is bounded whatever the number of distinct pieces.
    """

    def __init__(self, compute: Callable[[list[Any]], list[Any]], room: int):
        super().__init__()
        self.compute, self.room = compute, room
        self.older: dict[Any, Any] = {}

    def prepare(self, pieces: Iterable[Any]) -> None:
        """Make sure that all the pieces are in the younger generation."""
        wanted = [p for p in pieces if p not in self]
        if len(self) + len(wanted) > self.room and len(self) > 0:
            self.older = dict(self)
            self.clear()
            wanted = list(pieces)
        missing = []
        for p in wanted:
            known = self.older.get(p)
            if known is None:
                missing.append(p)
            else:
                self[p] = known
        if missing:
            self.update(zip(missing, self.compute(missing), strict=True))
