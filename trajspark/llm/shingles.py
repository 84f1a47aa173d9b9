"""Word-shingle sets as hashes, and keys that alike sets share (helpers of the near-duplicate operator).

A text is the set of its shingles of consecutive words (ASCII case and white
space do not count); fewer words than a shingle make one shingle of all of
them, so no set is empty.  Sets that agree in one of ``BANDS`` bands of
``ROWS`` minima share a key: a pair at similarity 0.8 does with probability
1 - (1 - 0.8 ** 5) ** 30, that is 0.999993.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

from .wordhash import Windows, hash_words, mix

BANDS, ROWS = 30, 5
#: Shingles whose minima are taken at once.
PIECE = 1 << 13
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_MIX = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64)) | np.uint64(1)


def windows_of(shingle: int) -> Windows:
    return Windows(shingle, 0x2545F4914F6CDD1D)


def shingles(text: bytes, windows: Windows) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted; never empty."""
    words = hash_words(text.lower())
    if len(words) >= windows.length:
        return np.unique(windows(words))
    return np.array([xxh64_intdigest(words.tobytes(), windows.length)], np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), PIECE):
        np.minimum(least, (found[at : at + PIECE, None] * _FACTORS).min(0), out=least)
    keys = _MIX.copy()
    for row in range(ROWS):
        keys = mix(keys ^ least[row::ROWS])
    return keys


def set_id(found: np.ndarray) -> int:
    return xxh64_intdigest(found.tobytes(), 7)
