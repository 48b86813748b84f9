"""Words and word shingles of whole Arrow batches as numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pandas as pd

#: A word is a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that any of them can be used alone."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def word_codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of all words, one text after the other, and the number of words of each text."""
    found = [WORD.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    words = np.empty(int(counts.sum()), dtype=object)
    words[:] = list(chain.from_iterable(found))
    if not len(words):
        return np.empty(0, dtype=np.uint64), counts
    return pd.util.hash_array(words, categorize=True), counts


def windows(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows, the text each is from and its place among the text's words."""
    size = len(codes) - width + 1
    if size <= 0:
        empty = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), empty, empty
    h = np.zeros(size, dtype=np.uint64)
    for j in range(width):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIERS[j % 5]) + codes[j : j + size]
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(codes)) - starts[owner]
    whole = (place + width <= counts[owner])[:size]
    return mix(h[whole]), owner[:size][whole], place[:size][whole]


def distinct_windows(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of each text, sorted in each text, and how many each text has."""
    h, owner, _ = windows(codes, counts, width)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[first], owner[first]
    return h, np.bincount(owner, minlength=len(counts)).astype(np.int64)
