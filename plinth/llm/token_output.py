"""Token-ID output: Parquet list columns, written in id order and read back selectively.

The file format (one folder of Parquet files, ascending ids within and across files):

    doc_id bigint        the document
    shard int            number of the file's range of ids, ascending with doc_id
    shard_start bigint   ids of the documents before it in the shard
    n_tokens bigint      ids of the document, the end id included
    tokens array<int>    the ids

`tokens` is dictionary encoded ("dictionary") or delta encoded ("delta": Parquet's
DELTA_BINARY_PACKED through writer version 2).  Row groups and pages have stated
sizes, and Parquet's column and offset indexes let a reader fetch the metadata
columns alone or the pages of some ids alone (`read_tokens`).

Encoding is per distinct chunk of text.  Texts are cut where the byte-level
pre-tokenizer always cuts (before a single space, between a letter and
punctuation), so the ids of a text are those of its chunks, one after another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm import shared, textbytes
from plinth.llm.wordcache import WordCache

#: Fixed values of GPT-2's byte-level alphabet: bytes that stand for themselves; the others follow from code point 256.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = dict(zip([*_SELF, *(b for b in range(256) if b not in set(_SELF))], map(chr, [*_SELF, *range(256, 256 + 256 - len(_SELF))]), strict=True))
#: GPT-2's pre-tokenizer pattern (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_VISIBLE = np.zeros(256, bool)  # ASCII that is no white space
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCTUATION = np.zeros(256, bool)  # without |, which may be inside <|endoftext|>
_PUNCTUATION[0x21:0x30] = _PUNCTUATION[0x3A:0x41] = _PUNCTUATION[0x5B:0x61] = _PUNCTUATION[0x7B:0x7F] = True
_PUNCTUATION[0x7C] = False


def chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where chunks start: places where the pre-tokenizer cuts whatever stands around them."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        seen, space = _VISIBLE[raw], raw == 0x20
        cut[1:-1] |= space[1:] & seen[:-1]
        cut[: len(raw) - 1] |= space[:-1] & seen[1:]
        cut[1:-1] |= _PUNCTUATION[raw[1:]] & _LETTER[raw[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class ByteLevelEncoder:
    """Ids of whole texts by the tokenizers library, each distinct chunk encoded once."""

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern, self.cache = regex.compile(_PATTERN), WordCache()

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, known = self.tokenizer.model, {}

        def piece(token: str) -> list[int]:
            if token not in known:
                known[token] = [t.id for t in model.tokenize(token.encode().decode("latin-1").translate(_ALPHABET))]
            return known[token]

        ids: list[int] = []
        size = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            before = len(ids)
            if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
                ids += piece(chunk)
            elif any(a in chunk for a in self.added):
                ids += self.tokenizer.encode(chunk, add_special_tokens=False).ids
            else:
                for token in self.pattern.findall(chunk):
                    ids += piece(token)
            size[i] = len(ids) - before
        return np.array(ids, np.uint16), size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        raw, offsets = textbytes.buffers(texts)
        starts = chunk_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(raw))
        ids, size = self.cache.encode(textbytes.hashes(raw, starts, ends), lambda at: self._chunk_ids([raw[starts[i] : ends[i]].tobytes().decode() for i in at]))
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)])


_ENCODER: dict[tuple[str, str], ByteLevelEncoder] = {}


def _encoder(tokenizer_file: str, run: str) -> ByteLevelEncoder:
    """This worker's encoder for all tasks of one run."""
    if (tokenizer_file, run) not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[tokenizer_file, run] = ByteLevelEncoder(tokenizer_file)
    return _ENCODER[tokenizer_file, run]


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int | None = 2,
    encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 256, codec: str = "zstd",
) -> None:
    """Writes the ids of every whole text to `path`, in ascending order of the id column.

    Null texts count as empty and get the end id alone; null ids come first;
    rows that repeat an id are all written, ordered by their text.  Other columns
    are left out.  Needs a vocabulary of at most 65,536 ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, before = _encoder(tokenizer_file, path), TaskContext.get().partitionId(), 0
        end = [] if end_id is None else [end_id]
        for whole in batches:
            for batch in shared.sliced(whole, 1):
                ids, size = encoder.encode(batch.column(1))
                ends = np.cumsum(size)
                ids = np.insert(ids.astype(np.int32), np.repeat(ends, len(end)), end * len(ends))
                size = size + len(end)
                ends = np.cumsum(size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(size), shard), pa.int32()), pa.array(before + ends - size, pa.int64()), pa.array(size, pa.int64()), shared.lists(ids, ends, pa.int32())], ["doc_id", "shard", "shard_start", "n_tokens", "tokens"])
                before += int(size.sum())

    options = {"compression": codec, "parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": str(encoding == "dictionary").lower()}
    if encoding == "delta":
        options["parquet.writer.version"] = "PARQUET_2_0"
    elif encoding != "dictionary":
        raise ValueError("encoding is dictionary or delta")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, tokens array<int>").write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: tuple[int, int] | None = None) -> DataFrame:
    """Documents with `start` (ids of all documents before) and their tokens; ids: first and last id wanted, pushed to the pages' index.

    Only the shards' totals, a row for each file, are summed in one place.
    """
    rows = spark.read.schema("doc_id bigint, shard int, shard_start bigint, n_tokens bigint, tokens array<int>").parquet(path)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    base = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("base"))
    wanted = rows if ids is None else rows.filter(F.col("doc_id").between(*ids))
    return wanted.join(base, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "tokens")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            ends, data = np.asarray(column.offsets, np.int64), memoryview(np.asarray(column.values.cast(pa.uint32()), "<u4"))
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "tokens").mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that were written.

    Null and empty texts are the end id alone; very long texts are one list; repeated
    ids follow one another; an empty table gives empty files and no rows.
    """
    import public_tokenizers

    path = shared.scratch(spark, "tokens")
    write_tokens(shared.load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digests(read_tokens(spark, path))
