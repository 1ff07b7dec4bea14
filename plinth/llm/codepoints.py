"""Sparse exception index: byte and code-point positions of UTF-8 buffers.

Of a buffer with many texts only the multibyte characters are recorded: where
they start, and how many bytes beyond one a character there have been so far.
Between them positions are sums, so a cut is converted with one binary search
and the memory is that of the exceptions alone.
"""

from __future__ import annotations

import numpy as np


class Exceptions:
    """Index of the multibyte characters of `raw`, the bytes of valid UTF-8."""

    def __init__(self, raw: np.ndarray):
        self.at = np.flatnonzero(raw >= 0xC0)  # first bytes of multibyte characters
        first = raw[self.at]
        excess = 1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])  # excess bytes of the first k exceptions
        self.char = self.at - self.before[:-1]  # number of the character in the buffer

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before the byte cuts `at`, which lie between characters."""
        return at - self.before[np.searchsorted(self.at, at)]

    def bytes(self, char: np.ndarray) -> np.ndarray:
        """Bytes before the code-point cuts `char`."""
        return char + self.before[np.searchsorted(self.char, char)]

    def code_points(self, raw: np.ndarray) -> np.ndarray:
        """Values of the recorded characters."""
        first = raw[self.at].astype(np.int64)
        size = 2 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
        value = first & (0xFF >> (size + 1))
        for k in range(1, 4):
            more = size > k
            value[more] = value[more] << 6 | (raw[self.at[more] + k] & 0x3F)
        return value
