"""Benchmark decontamination by a distributed positional inverted index.

Training documents are indexed where they are: each task turns a segment of them
into the positional postings of the benchmark's terms.  A window (`window`
consecutive words of an item, or a whole shorter item) is looked up from its
rarest term, by counts over all documents: the term's positions, less its offset
in the window, are candidate starts, and the lists of the other terms are
intersected with them in order of rarity, each moved by its own offset.  What is
left are exact phrase matches.  `proximity_matches` asks only that the rarest
terms of a window stand near each other.

No document is shuffled.  The benchmark is cut into blocks of about
`block_words` words, whatever its size, and documents pass the blocks one after
another; a block is what is broadcast.  Word identity is a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import shared, textbytes

_STEP = 1 << 20  # candidate starts that are looked at together
#: Bytes of text whose words are hashed at once: their arrays are several times as large.
_SLICE = 1 << 21


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words of all texts, index of each text's first word, of length rows + 1)."""
    raw, offsets = textbytes.buffers(texts)
    raw = textbytes.lower(raw)
    starts, ends, first = textbytes.words(raw, offsets, textbytes.ALNUM)
    return textbytes.hashes(raw, starts, ends), first


@dataclass
class Windows:
    """The distinct windows of a block of items, each with its terms from the rarest."""

    terms: np.ndarray  # sorted distinct hashes
    size: np.ndarray  # words of each window
    offset: np.ndarray  # [window, k]: where the k-th rarest term stands; -1 beyond the window
    term: np.ndarray  # [window, k]: index into terms
    by_first: np.ndarray  # windows in order of their rarest term
    first_at: np.ndarray  # where each term's windows start in by_first
    items: list[np.ndarray]  # item ids of each window


def _pieces(benchmark: DataFrame, id_column: str, text_column: str, window: int, piece_words: int) -> DataFrame:
    """(item, words): the hashes of an item's words, long items in overlapping pieces that share no window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, 1, _SLICE):
                h, first = word_hashes(batch.column(1))
                for i, item in enumerate(batch.column(0).to_pylist()):
                    own = h[first[i] : first[i + 1]]
                    for at in range(0, max(1, len(own) - window + 1), piece_words):
                        if len(own):
                            yield pa.RecordBatch.from_pydict({"item": [item], "words": [own[at : at + piece_words + window - 1].astype("<u8").tobytes()]}, pa.schema([("item", pa.int64()), ("words", pa.binary())]))

    rows = benchmark.select(F.col(id_column).cast("bigint").alias("item"), F.col(text_column).cast("string").alias("text"))
    return rows.filter(F.col("item").isNotNull()).mapInArrow(cut, "item bigint, words binary")


def _windows(pieces: list, window: int) -> tuple[np.ndarray, dict[bytes, set[int]]]:
    found: dict[bytes, set[int]] = {}
    for p in pieces:
        size = len(p.words) // 8
        n = min(window, size)
        for at in range(size - n + 1):
            found.setdefault(bytes(p.words[8 * at : 8 * (at + n)]), set()).add(p.item)
    terms = np.unique(np.frombuffer(b"".join(found), "<u8"))
    return terms, found


def _ranked(terms: np.ndarray, found: dict[bytes, set[int]], counts: np.ndarray, window: int) -> Windows:
    n = len(found)
    size = np.array([len(w) // 8 for w in found], np.int64)
    term, offset = np.full((n, window), -1), np.full((n, window), -1)
    for i, w in enumerate(found):
        own = np.searchsorted(terms, np.frombuffer(w, "<u8"))
        order = np.lexsort((np.arange(len(own)), own, counts[own]))
        term[i, : len(own)], offset[i, : len(own)] = own[order], order
    by_first = np.argsort(term[:, 0], kind="stable")
    return Windows(terms, size, offset, term, by_first, np.searchsorted(term[by_first, 0], np.arange(len(terms) + 1)), [np.array(sorted(x), np.int64) for x in found.values()])


def _term_ids(h: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Index into terms of each word, -1 for words that no item has."""
    at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
    return np.where(terms[at] == h, at, -1) if len(terms) else np.full(len(h), -1)


def _postings(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in order of (term, position), their terms)."""
    at = np.flatnonzero(ids >= 0)
    order = np.argsort(ids[at], kind="stable")
    return at[order], ids[at[order]]


def phrase_matches(ids: np.ndarray, first: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every occurrence of every window in the segment's words."""
    position, term = _postings(ids)
    doc_end = np.repeat(first[1:], np.diff(first))
    doc_start = np.repeat(first[:-1], np.diff(first))
    fan = np.diff(w.first_at)[term]  # windows whose rarest term this is
    position, term, fan = (x[fan > 0] for x in (position, term, fan))
    to, out = np.cumsum(fan), []
    at = 0
    while at < len(position):
        stop = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + _STEP, "right")))
        n = fan[at:stop]
        window = w.by_first[np.repeat(w.first_at[term[at:stop]], n) + textbytes.runs(n)]
        here = np.repeat(position[at:stop], n)
        start = here - w.offset[window, 0]
        ok = (start >= doc_start[here]) & (start + w.size[window] <= doc_end[here])
        start, window = start[ok], window[ok]
        for k in range(1, w.offset.shape[1]):
            o = w.offset[window, k]
            ok = (o < 0) | (ids[np.minimum(start + np.maximum(o, 0), len(ids) - 1)] == w.term[window, k])
            start, window = start[ok], window[ok]
        out.append((start, window))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_matches(ids: np.ndarray, first: np.ndarray, w: Windows, terms: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the rarest term, window) where the window's `terms` rarest terms all stand within `within` words of it."""
    position, term = _postings(ids)
    fan = np.diff(w.first_at)[term]
    window = w.by_first[np.repeat(w.first_at[term], fan) + textbytes.runs(fan)]
    here = np.repeat(position, fan)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = term.astype(np.int64) * (len(ids) + 1) + position
    for k in range(1, min(terms, w.term.shape[1])):
        t = w.term[window, k]
        lowest = np.maximum(here - within, first[doc[here]])
        highest = np.minimum(here + within, first[doc[here] + 1] - 1)
        left = np.searchsorted(key, np.maximum(t, 0) * (len(ids) + 1) + lowest)
        right = np.searchsorted(key, np.maximum(t, 0) * (len(ids) + 1) + highest, "right")
        ok = (t < 0) | (right > left)
        here, window = here[ok], window[ok]
    return here, window


class Index:
    """The blocks of a benchmark, each with its terms counted over all documents."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = 10, block_words: int = 2_000_000, piece_words: int = 100_000):
        self.spark, self.window = docs.sparkSession, window
        words = _pieces(benchmark, item_column, item_text_column, window, piece_words)
        total = words.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
        n = max(1, math.ceil(total / block_words))
        texts = docs.select(F.col(text_column).cast("string").alias("text"))
        self.blocks = []
        for b in range(n):
            own = words if n == 1 else words.filter(F.pmod(F.xxhash64("item", "words"), F.lit(n)) == b)
            terms, found = _windows(own.collect(), window)  # a block: about block_words words
            if found:
                self.blocks.append(self.spark.sparkContext.broadcast(_ranked(terms, found, self._counts(texts, terms), window)))

    def _counts(self, texts: DataFrame, terms: np.ndarray) -> np.ndarray:
        """Occurrences of each of the block's terms in all documents."""
        shared_terms = self.spark.sparkContext.broadcast(terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared_terms.value
            total = np.zeros(len(known), np.int64)
            for whole in batches:
                for batch in shared.sliced(whole, 0, _SLICE):
                    ids = _term_ids(word_hashes(batch.column(0))[0], known)
                    total += np.bincount(ids[ids >= 0], minlength=len(known))
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int64()), pa.array(total[has])], ["term", "n"])

        out = np.zeros(len(terms), np.int64)
        for r in texts.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
            out[r["term"]] = r["n"]
        return out


def find(docs: DataFrame, index: Index, *, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, spans (word positions [from, to, from, to, ...] that windows cover, merged), items (sorted ids), and the columns in `keep`, for every row.

    Null and empty texts have no words.  Rows are looked at one by one: repeated
    or null ids change nothing.  Null item ids and items without words are no items.
    """
    nothing = {"n_words": "bigint", "spans": "array<bigint>", "items": "array<bigint>"}
    same = docs.schema[text_column].dataType == T.StringType()  # then a kept text goes to the workers once
    also = [c for c in keep if not (same and c == text_column)]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *(F.lit(None).cast(k).alias(c) for c, k in nothing.items()), *(F.col(c).alias(f"keep_{c}") for c in also))

    def look(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = block.value if block else None
            for whole in batches:
                for batch in shared.sliced(whole, 1, _SLICE):
                    h, first = word_hashes(batch.column(1))
                    size = np.diff(first)
                    spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                    if w is not None:
                        start, window = phrase_matches(_term_ids(h, w.terms), first, w)
                        doc = np.searchsorted(first, start, "right") - 1
                        order = np.lexsort((start, doc))
                        cut = np.flatnonzero(np.diff(doc[order])) + 1
                        for own in np.split(order, cut) if len(order) else []:
                            d = int(doc[own[0]])
                            spans[d] = merged(np.stack([start[own], start[own] + w.size[window[own]]], 1) - first[d], spans[d])
                            items[d] = sorted({*(items[d] or ()), *(int(x) for k in np.unique(window[own]) for x in w.items[k])})
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array([s or [] for s in spans], pa.list_(pa.int64())), pa.array([s or [] for s in items], pa.list_(pa.int64())), *batch.columns[5:]], batch.schema.names)

        return run

    for block in index.blocks or [None]:
        rows = rows.mapInArrow(look(block), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
    return rows.select(F.col("id").alias(id_column), "n_words", "spans", "items", *(F.col(f"keep_{c}" if c in also else "text").alias(c) for c in keep))


def merged(spans: np.ndarray, more: list[int] | None) -> list[int]:
    """Union of half-open ranges, flat and ascending."""
    if more:
        spans = np.concatenate([spans, np.array(more).reshape(-1, 2)])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], 1).ravel().tolist()


def proximity_matches(docs: DataFrame, index: Index, *, id_column: str = "doc_id", text_column: str = "text", terms: int = 3, within: int = 20) -> DataFrame:
    """(id, item, n): how often the `terms` rarest terms of one of the item's windows stand within `within` words of the rarest."""

    def look(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = block.value
            for whole in batches:
                for batch in shared.sliced(whole, 1, 1 << 20):
                    h, first = word_hashes(batch.column(1))
                    here, window = near_matches(_term_ids(h, w.terms), first, w, terms, within)
                    doc = np.searchsorted(first, here, "right") - 1
                    found = sorted({(int(d), int(p), int(x)) for d, p, k in zip(doc, here, window, strict=True) for x in w.items[k]})
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _, _ in found], pa.int64())), pa.array([x for _, _, x in found], pa.int64())], ["id", "item"])

        return run

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    out = [rows.mapInArrow(look(b), "id bigint, item bigint") for b in index.blocks]
    if not out:
        return rows.select("id", F.lit(None).cast("bigint").alias("item"), F.lit(0).cast("bigint").alias("n")).limit(0)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("id", "item").agg(F.count(F.lit(1)).alias("n"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Null and wordless texts have no words and no hits; items without words or id match
    nothing; equal items of different ids all count; repeated rows have equal results;
    very long texts are searched whole; without items or documents nothing is hit.
    """
    docs = shared.load(spark, sf_dir, "documents")
    found = find(docs, Index(docs, shared.load(spark, sf_dir, "benchmark")))
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
     hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, phrase)),
     covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
     named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
