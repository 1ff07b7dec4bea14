"""Vectorised word kernels over the UTF-8 buffers of Arrow string columns.

Every function works on whole batches: the texts of a batch are one byte buffer
with offsets, words are runs of "word bytes" in it, and a word's 64-bit hash is
a multilinear hash of its bytes.  Nothing loops over rows or characters in
Python, so the operators that need words, shingles or n-grams of whole texts
stay within a few passes over the bytes.

Null texts count as empty.  Bytes of different rows never share a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TABLE = 512  # positions with a multiplier of their own; longer words are hashed block by block
_RNG = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLIER = _RNG.integers(1, 2**63, size=_TABLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# Byte classes.  Bytes of 0x80 and above belong to multi-byte characters and are word bytes in all of them.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
NOT_SPACE = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    if np.ndim(h) == 0:
        return mix(np.array([h], np.uint64))[0]
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets as int64 of length rows + 1); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of each word, and first[i]: index of row i's first word, of length rows + 1."""
    inside = word_byte[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a word may start here: row starts cut words
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1 : len(raw)]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1 : len(raw)]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[start:end] for each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    if size.max() > _TABLE:  # cut long words into blocks, then hash the blocks' hashes with their number
        long = np.flatnonzero(size > _TABLE)
        out = np.zeros(len(starts), np.uint64)
        rest = np.flatnonzero(size <= _TABLE)
        out[rest] = hashes(raw, starts[rest], ends[rest])
        for i in long:
            cut = np.arange(starts[i], ends[i], _TABLE)
            part = hashes(raw, cut, np.minimum(cut + _TABLE, ends[i]))
            out[i] = mix(np.bitwise_xor.reduce(mix(part + np.arange(1, len(part) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(int(size[i])))
        return out
    first = np.cumsum(size) - size
    at = np.arange(total) - np.repeat(first, size)  # position in the word
    byte = raw[at + np.repeat(starts, size)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(byte * _MULTIPLIER[at], first) + size.astype(np.uint64))


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[raw]


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n in lengths, one after another."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
