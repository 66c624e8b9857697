"""Words of texts as 64-bit hashes in arrays, a batch at a time."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from itertools import chain

import numpy as np
import xxhash
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Odd multipliers, one for each place in a window.
MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"place", i) | 1 for i in range(32)], np.uint64)


class WordHashes(dict):
    """Hash of a word's bytes, remembered; forgotten all at once when there are too many."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def lower_words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: what ``bytes`` does by itself."""
    return text.lower().split() if text else []


def hashed(words: Sequence[list[bytes]], memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in a row, and where each text's words start (one more entry than texts)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    values = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.uint64, int(starts[-1]))
    return values, starts


def mixed(values: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word (the finaliser of a public 64-bit hash)."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def windows(values: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """A hash of the words at the given places of the window that starts at each word; one for every start that has
    room for the whole window."""
    room = len(values) - max(places)
    total = np.zeros(max(0, room), np.uint64)
    if room > 0:
        for n, place in enumerate(places):
            total += values[place : place + room] * MULTIPLIERS[n]
    return mixed(total)
