"""SentencePiece encoding and decoding by shared-prefix forward search.

A text is marked as SentencePiece does (a space before it, spaces as U+2581) and
cut before each run of marks, which no piece of the vocabulary spans.  Distinct
words are sorted, which makes a trie of them, and the trie is traversed
depth-first: the forward state of a prefix is computed once, whichever words go on
from it.

The vocabulary at hand is a BPE model, whose result isn't the path of the largest
sum of scores, so the lattice holds merge feasibility for scores: a piece may
follow another only if merging the two pieces' characters gives these two pieces.
A sequence of pieces is the BPE result if and only if all its neighbours are so,
and the last piece of each prefix is then unique; the forward state is that piece,
and backtracking from a word's end gives its pieces.  Results are those of the
sentencepiece library.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import shared, textbytes
from plinth.llm.wordcache import WordCache

_MARK = "▁"
_OTHER = -1  # a character that no piece has: spelt in bytes
#: What a worker remembers: pairs of pieces (about 130 bytes each) and, in wordcache, words (about 40 bytes each).
_MOST_PAIRS, _MOST_WORDS = 400_000, 1_000_000
#: Bytes of text that are encoded at once; the kernels take about forty times as much.
_SLICE = 2 << 20


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in normal}
        self.score = {i: model.get_score(i) for i in normal}
        self.piece = {i: p for p, i in self.id.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id), default=1)
        if any(_MARK in p.lstrip(_MARK) for p in self.id):
            raise ValueError("a piece goes over a word's end")
        self.follows: dict[int, bool] = {}
        self.spelt = [b""] * n  # each id's bytes
        for i in normal:
            self.spelt[i] = self.piece[i].replace(_MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.spelt[i] = bytes([b])

    def merged(self, word: str) -> list[str]:
        """Plain BPE: the adjacent pair with the best score is merged first, the leftmost of equals."""
        parts = list(word)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.id.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece b can stand after piece a (0: the word's start, _OTHER: a character spelt in bytes)."""
        pair = (a + 1) << 32 | b
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) >= _MOST_PAIRS:
                self.follows.clear()
            left, right = self.piece.get(a, ""), self.piece[b]
            known = self.follows[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the words, which are sorted, by depth-first traversal of their trie."""
        last, out, before = [0], [], ""  # last[i]: last piece of the first i characters
        for word in words:
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common + 1 :]
            for i in range(common + 1, len(word) + 1):
                for j in range(max(0, i - self.longest), i):
                    piece = self.id.get(word[j:i])
                    if piece is not None and self.may_follow(last[j], piece):
                        last.append(piece)
                        break
                else:
                    last.append(_OTHER)
            ids: list[int] = []
            i = len(word)
            while i:
                if last[i] == _OTHER:
                    ids += [self.byte[b] for b in reversed(word[i - 1].encode())]
                    i -= 1
                else:
                    ids.append(last[i])
                    i -= len(self.piece[last[i]])
            out.append(ids[::-1])
            before = word
        return out


class Codec:
    def __init__(self, model_file: str):
        self.vocabulary, self.cache = Vocabulary(model_file), WordCache(_MOST_WORDS)
        spelt = self.vocabulary.spelt
        self.size = np.array([len(s) for s in spelt], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null texts are empty, empty ones have none."""
        raw, offsets = textbytes.buffers(pc.replace_substring(texts, _MARK, " "))
        begins = offsets[:-1][np.diff(offsets) > 0]
        raw = np.insert(raw, begins, 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        space = raw == 0x20
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts

        def code(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = [raw[starts[i] : ends[i]].tobytes().decode().replace(" ", _MARK) for i in at]
            order = sorted(range(len(words)), key=words.__getitem__)
            ids: list[list[int]] = [[]] * len(words)
            for k, found in zip(order, self.vocabulary.encode_sorted([words[k] for k in order]), strict=True):
                ids[k] = found
            return np.array([x for own in ids for x in own], np.uint16), np.array([len(own) for own in ids], np.int64)

        ids, size = self.cache.encode(textbytes.hashes(raw, starts, ends), code) if len(starts) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray, size: np.ndarray) -> pa.Array:
        """Texts of ids, without the space that marks their start."""
        width = self.size[ids]
        raw = self.bytes[np.repeat(self.start[ids], width) + textbytes.runs(width)]
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(size)])]
        begins = ends[:-1][np.diff(ends) > 0]
        raw = np.delete(raw, begins)
        ends = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.string())


_CODEC: dict[tuple[str, str], Codec] = {}


def _codec(model_file: str, run: str) -> Codec:
    """This worker's codec for all tasks of one run."""
    if (model_file, run) not in _CODEC:
        _CODEC.clear()
        _CODEC[model_file, run] = Codec(model_file)
    return _CODEC[model_file, run]


def encode(docs: DataFrame, model_file: str, *, text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """All rows and columns, and the ids of each whole text; null and empty texts have none. A column named ids_column is replaced."""
    run = shared.scratch(docs.sparkSession, "run")
    rest = [c for c in docs.columns if c != ids_column]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids_column, T.ArrayType(T.IntegerType()))])
    at = rest.index(text_column)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file, run)
        for whole in batches:
            for batch in shared.sliced(whole, at, _SLICE):
                ids, size = codec.encode(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns, shared.lists(ids.astype(np.int32), np.cumsum(size), pa.int32())], [*rest, ids_column])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(apply, schema)


def decode(tokens: DataFrame, model_file: str, *, ids_column: str = "token_ids", text_column: str = "decoded") -> DataFrame:
    """All rows and columns, and the text of the ids; null ids give an empty text. A column named text_column is replaced."""
    run = shared.scratch(tokens.sparkSession, "run")
    rest = [c for c in tokens.columns if c != text_column]
    schema = T.StructType([*(tokens.schema[c] for c in rest), T.StructField(text_column, T.StringType())])
    at = rest.index(ids_column)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file, run)
        for whole in batches:
            for first in range(0, len(whole), 512):
                batch = whole.slice(first, 512)
                column = batch.column(at)
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, codec.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size)], [*rest, text_column])

    return tokens.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(apply, schema)


def encode_and_decode(docs: DataFrame, model_file: str, *, text_column: str = "text", ids_column: str = "token_ids", decoded_column: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass. Columns named ids_column or decoded_column are replaced."""
    run = shared.scratch(docs.sparkSession, "run")
    rest = [c for c in docs.columns if c not in (ids_column, decoded_column)]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField(ids_column, T.ArrayType(T.IntegerType())), T.StructField(decoded_column, T.StringType())])
    at = rest.index(text_column)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file, run)
        for whole in batches:
            for batch in shared.sliced(whole, at, _SLICE):
                ids, size = codec.encode(batch.column(at))
                texts = codec.decode(ids.astype(np.int64), size)
                yield pa.RecordBatch.from_arrays([*batch.columns, shared.lists(ids.astype(np.int32), np.cumsum(size), pa.int32()), texts], [*rest, ids_column, decoded_column])

    return docs.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(apply, schema)


def digests(docs: DataFrame, model_file: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip (the ids decode to the text, U+2581 being a space), one row for each row.

    One pass encodes, decodes and compares, so a worker holds one codec and texts go
    to it once.  Null texts are empty; repeated rows give repeated results.
    """
    run = shared.scratch(docs.sparkSession, "run")
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_file, run)
        for whole in batches:
            for batch in shared.sliced(whole, 1, _SLICE):
                ids, size = codec.encode(batch.column(1))
                back = codec.decode(ids.astype(np.int64), size)
                same = pc.equal(back, pc.replace_substring(pc.fill_null(batch.column(1), ""), _MARK, " ").cast(back.type))
                ends, data = np.cumsum(size), memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(crc, pa.int64()), same], [id_column, "n_tokens", "ids_crc32", "round_trip"])

    return docs.select(id_column, F.col(text_column).alias(f"{text_column}_")).mapInArrow(apply, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and round_trip (whether the decoded ids are the text) of every document.

    Null and empty texts have no tokens, repeated rows have repeated results, an empty
    table has none; very long texts are encoded whole.
    """
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return digests(shared.load(spark, sf_dir, "documents"), model)
