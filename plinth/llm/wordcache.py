"""A worker's memory of the codes of distinct words, bounded and vectorised.

Word frequencies are Zipfian, so a tokenizer that sees each distinct word once
does a few per cent of the work.  Each Python worker keeps the codes of the words
it has met in sorted arrays; a batch looks all its words up at once and encodes
those that are missing.  When more than `most` words are held, the memory starts
anew: results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class WordCache:
    def __init__(self, most: int = 1_500_000):
        self.most = most  # words
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted word hashes
        self.at = np.zeros(0, np.int64)  # where a word's codes start
        self.size = np.zeros(0, np.int64)
        self.codes = np.zeros(0, np.uint16)

    def encode(self, keys: np.ndarray, code: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(codes of all words in order, number of codes of each).

        code(indices) encodes the words at the given positions and returns the
        same two arrays for them; it is called with one position for each
        distinct word that isn't held.
        """
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.key, distinct)
        held = slot < len(self.key)
        held[held] = self.key[slot[held]] == distinct[held]
        if not held.all():
            new = np.flatnonzero(~held)
            if len(self.key) + len(new) > self.most and len(self.key):
                self.clear()
                new = np.arange(len(distinct))
            codes, size = code(first[new])
            at = len(self.codes) + np.cumsum(size) - size
            self.codes = np.concatenate([self.codes, codes])
            where = np.searchsorted(self.key, distinct[new])
            self.key = np.insert(self.key, where, distinct[new])
            self.at = np.insert(self.at, where, at)
            self.size = np.insert(self.size, where, size)
            slot = np.searchsorted(self.key, distinct)
        size = self.size[slot][back]
        at = np.repeat(self.at[slot][back] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.codes[at], size
