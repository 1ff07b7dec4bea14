"""Removal of long repeated byte strings by run-length indexes of repetitive regions.

A byte goes if a string of `length` bytes that covers it starts anywhere else.

1. Winnowing.  In each string of `length` bytes the k-gram with the smallest hash
   (the leftmost of equals) is its anchor; equal strings have equal anchors at
   equal places.  So only the surroundings of anchors that occur more than once
   can hold a match; the rest of the corpus, most of it, is never indexed.
2. Surroundings (all strings that have the anchor, no others) that are equal as a
   whole are one class.  Those of a class with several places go at once; a place
   of each class goes on where an anchor has several classes.
3. These meet in buckets by anchor, cut by anchor again into parts that fit a
   processor's cache.  A part's regions, each byte of a document once, get a
   run-length index: suffix array, Burrows-Wheeler transform cut into
   runs, and samples at the runs' ends.  The longest common prefix of a suffix
   with the one before it is sampled where a run begins; streaming over the text
   from right to left it is the next sample plus the distance, which gives the
   matching statistics of every position without comparing any further.
4. An anchor with more than `most_contexts` classes isn't brought together: its
   strings are grouped by two hashes of themselves.

Equal texts are one text throughout, found by two 64-bit hashes and the length.
Surroundings and strings are told apart by 126 bits of two kinds of hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared, textbytes

_K = 32  # bytes of an anchor
_RNG = np.random.Generator(np.random.PCG64(7))
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_END = 0xFF  # never in UTF-8
_AT_BITS = np.uint64(31)  # positions in a batch; as many everywhere, so that equal strings choose alike in all batches
_KEY = ["h1", "h2", "n_bytes"]


_PRIMES = (2**31 - 1, 2**31 - 19)
_BASES = (1_103_515_245, 1_664_525_123)
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base; those of a million or fewer are kept for the next texts."""
    known = _POWERS.get((base, modulus))
    if known is None or len(known) < n:
        known, size = np.array([1], np.uint64), max(n, 1 << 16)
        while len(known) < size:
            more = known[: size - len(known)] * np.uint64(pow(base, len(known), modulus))
            known = np.concatenate([known, more if modulus == 2**64 else more % np.uint64(modulus)])
        if size <= 1 << 20:
            _POWERS[base, modulus] = known
    return known[:n]


class Rolling:
    """Hashes of any substrings of `raw` in constant time each."""

    def __init__(self, raw: np.ndarray):
        self.up = _powers(_P, len(raw) + 1, 2**64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _powers(pow(_P, -1, 2**64), len(raw), 2**64))])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textbytes.mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of k bytes, as `of` gives them."""
        return textbytes.mix((self.sums[k:] - self.sums[:-k]) * self.up[: len(self.sums) - k] + np.uint64(k))


class Residues:
    """Hashes of any substrings modulo two primes, 62 bits in all; they share nothing with Rolling's, whose modulus is a power of two."""

    def __init__(self, raw: np.ndarray):
        self.n, self.sums = len(raw) + 1, []
        byte = raw.astype(np.uint64) + np.uint64(1)
        for base, p in zip(_BASES, _PRIMES, strict=True):
            terms = byte * _powers(pow(base, -1, p), len(raw), p)  # below 2^40
            if len(raw) > 1 << 24:  # whose sum is below 2^64 without
                terms %= np.uint64(p)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(terms)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        parts = [(s[end] - s[start]) % np.uint64(p) * _powers(base, self.n, p)[start] % np.uint64(p) for s, base, p in zip(self.sums, _BASES, _PRIMES, strict=True)]
        return parts[0] << np.uint64(31) | parts[1]


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every i, by running minima from both ends of blocks of w."""
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, roll: Rolling, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of `length` bytes within a text: position, start of the first string that has it, end of the last.

    A string has one anchor, and strings of one anchor start one after another.
    """
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 3
    gram = roll.grams(_K)
    low = _window_minima(((gram >> _AT_BITS) << _AT_BITS) | np.arange(len(gram), dtype=np.uint64), length - _K + 1)
    last = np.repeat(offsets[1:], np.diff(offsets))[: len(low)] - length
    inside = np.flatnonzero(np.arange(len(low)) <= last)
    at = (low[inside] & ((np.uint64(1) << _AT_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    return at[first], inside[first], inside[np.append(first[1:], len(at))[: len(first)] - 1] + length


class RunLengthIndex:
    """Suffix array, run-length Burrows-Wheeler transform and run-end samples of a text."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = np.concatenate([text, np.zeros(8, np.uint8)])
        packed = np.zeros(n, np.uint64)
        for k in range(8):
            packed = (packed << np.uint64(8)) | self.text[k : k + n]
        order = np.argsort(packed)
        rank = self._ranks(order, packed)
        self.packed, step = packed, 8
        while True:  # rank: position of the first suffix with the same `step` first bytes
            same = np.append(rank[order[1:]] == rank[order[:-1]], False)
            same |= np.append(False, same[:-1])
            open_at = np.flatnonzero(same)
            if not len(open_at):
                break
            after = np.concatenate([rank[step:] + (step + 1), np.arange(min(step, n), 0, -1)])  # of two that end, the shorter is first
            bits = int(n + step).bit_length()
            parts = max(2, 64 // bits)  # ranks side by side in a key
            key = rank.astype(np.uint64)
            for k in range(parts - 1):
                key <<= np.uint64(bits)
                key[: max(0, n - k * step)] |= after[k * step :].astype(np.uint64)
            own = order[open_at]
            key = key[own]
            by = np.argsort(key)
            own, key, new = own[by], key[by], np.empty(len(by), bool)
            order[open_at] = own
            new[0], new[1:] = True, key[1:] != key[:-1]
            rank[own] = np.maximum.accumulate(np.where(new, open_at, 0))
            step *= parts
        self.suffixes, self.rank = order, rank
        before = np.where(order > 0, self.text[order - 1], _END).astype(np.uint8)
        self.run_starts = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if n else np.zeros(0, np.int64)

    @staticmethod
    def _ranks(order: np.ndarray, packed: np.ndarray) -> np.ndarray:
        packed = packed[order]
        new = np.append(True, packed[1:] != packed[:-1]) if len(order) else np.zeros(0, bool)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        return rank

    def samples(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, common prefix with the suffix before, `most` at most) where it doesn't follow from the next position's."""
        starts = self.suffixes[self.run_starts]
        sampled = np.zeros(len(self.suffixes), bool)
        sampled[starts[starts > 0] - 1] = sampled[-1:] = True
        at = np.flatnonzero(sampled)
        row = self.rank[at]
        other = np.where(row > 0, self.suffixes[row - 1], -1)
        size, n = np.zeros(len(at), np.int64), len(self.suffixes)
        most_here = np.where(other >= 0, np.minimum(most, n - np.maximum(at, other)), 0)
        active = np.flatnonzero(most_here > 0)
        while len(active):  # eight bytes at a time
            differ = self.packed[at[active] + size[active]] ^ self.packed[other[active] + size[active]]
            size[active] += 8
            last = differ > 0
            for k in range(8):
                size[active[last & (differ >> np.uint64(8 * k) > 0)]] -= 1
            active = active[~last]
            active = active[size[active] < most_here[active]]
        return at, np.minimum(size, most_here)

    def repeated(self, length: int) -> np.ndarray:
        """For each position, whether its next `length` bytes start anywhere else too."""
        at, size = self.samples(length)
        common = np.repeat(size + at, np.diff(at, prepend=-1)) - np.arange(len(self.suffixes))  # with the suffix before, in order of the text
        before = common >= length
        after = np.zeros(len(before), bool)
        after[self.suffixes[:-1]] = before[self.suffixes[1:]]
        return before | after


def _spans(flags: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def repeated_spans(regions: list[tuple[tuple, int, bytes]], length: int) -> list[tuple[tuple, int, int]]:
    """(document, from, to) of the bytes that repeated strings cover; regions: (document, start, bytes), overlapping or not."""
    by: dict[tuple, list[tuple[int, bytes]]] = {}
    for doc, start, data in regions:
        by.setdefault(doc, []).append((start, data))
    pieces, places = [], []  # disjoint regions, (document, start, end, place in the text)
    at = 0
    for doc, own in by.items():
        own.sort()
        first, joined = own[0][0], bytearray(own[0][1])
        for start, data in [*own[1:], (2**62, b"")]:
            if start <= first + len(joined):
                joined += data[first + len(joined) - start :] if start + len(data) > first + len(joined) else b""
            else:
                pieces.append(bytes(joined) + bytes([_END]))
                places.append((doc, first, first + len(joined), at))
                at += len(pieces[-1])
                first, joined = start, bytearray(data)
    found = RunLengthIndex(np.frombuffer(b"".join(pieces), np.uint8)).repeated(length)
    out = []
    for doc, start, end, place in places:
        whole = found[place : place + max(0, end - start - length + 1)]
        out += [(doc, int(start + a), int(start + b + length - 1)) for a, b in _spans(whole)]
    return out


def _key_columns(text: str = "text") -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.col(text)).alias("h2"), F.octet_length(text).cast("bigint").alias("n_bytes")]


def find_repeats(docs: DataFrame, *, text_column: str = "text", length: int = 400, bucket_bytes: int = 3 << 20, part_bytes: int = 128 << 10, most_contexts: int = 4096, most_broadcast: int = 500_000) -> DataFrame:
    """(h1, h2, n_bytes, text, copies, spans) of each distinct text with bytes to remove; spans: ascending, disjoint, flat.

    Null texts are empty.  Equal texts of `length` bytes or more go whole.  Keys of
    at most `most_broadcast` texts are broadcast.
    """
    texts = docs.select(F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).select("text", *_key_columns())
    anchor_rows = "anchor bigint, context bigint, context2 bigint, h1 bigint, h2 bigint, n_bytes bigint, low int, high int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, 0, 256 << 10):  # arrays that fit a processor's cache
                raw, offsets = textbytes.buffers(batch.column(0))
                roll = Rolling(raw)
                at, low, high = anchors(raw, offsets, roll, length)
                row = np.searchsorted(offsets, at, "right") - 1
                context = textbytes.mix(roll.of(low, high) + (at - low).astype(np.uint64) * np.uint64(_P))
                second = Residues(raw).of(low, high)
                key = [c.take(pa.array(row)) for c in batch.columns[1:4]]
                hashes = [pa.array(x.view(np.int64)) for x in (roll.of(at, at + _K), context, second)]
                yield pa.RecordBatch.from_arrays([*hashes, *key, *(pa.array((x - offsets[row]).astype(np.int32)) for x in (low, high))], ["anchor", *around, *_KEY, "low", "high"])

    around = ["context", "context2"]
    # written once: each of the three uses below would read and hash all texts again; equal texts are one by then
    every = shared.table(texts.filter(F.col("n_bytes") >= length).mapInArrow(find, anchor_rows).dropDuplicates([*_KEY, "low"]), "anchors", compression="zstd")
    classes = every.groupBy("anchor", *around).agg(F.count(F.lit(1)).alias("places"), F.min(F.struct(*_KEY, "low")).alias("one"))
    classes = shared.table(classes, "classes", compression="zstd")
    found = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.sum("places").alias("all")).filter("all > 1").drop("all")
    kept = every.join(classes.join(found, "anchor"), ["anchor", *around])
    # whole: all its strings are elsewhere too; sent: stands for its class where there are others
    place = F.struct("low", "high", "anchor", (F.col("places") > 1).alias("whole"), ((F.col("classes") > 1) & (F.col("one") == F.struct(*_KEY, "low"))).alias("sent"), (F.col("classes") > most_contexts).alias("hot"))
    by_text = kept.select(*_KEY, place.alias("place")).groupBy(*_KEY).agg(F.collect_list("place").alias("places"))
    copies = texts.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"))
    wanted = copies.join(by_text, _KEY, "left").filter(F.col("places").isNotNull() | ((F.col("copies") > 1) & (F.col("n_bytes") >= length)))
    wanted = shared.table(wanted, "wanted", compression="zstd")
    keys = wanted.select(*_KEY)
    keys = F.broadcast(keys) if wanted.count() <= most_broadcast else keys  # so only texts with repeats are shuffled
    bodies = texts.join(keys, _KEY, "left_semi").groupBy(*_KEY).agg(F.first("text").alias("text"))
    known = shared.table(bodies.join(wanted, _KEY).select(*_KEY, "text", "copies", "places"), "repeats", compression="zstd")

    context_rows = "bucket int, part int, h1 bigint, h2 bigint, n_bytes bigint, start bigint, context binary"
    sent = known.select(*_KEY, "text", F.filter("places", lambda p: p["sent"] & ~p["hot"]).alias("places")).filter(F.size("places") > 0)
    sizes = F.aggregate("places", F.lit(0).cast("bigint"), lambda n, p: n + p["high"] - p["low"])
    buckets = max(1, -(-(sent.agg(F.sum(sizes)).first()[0] or 0) // bucket_bytes))
    parts = max(1, bucket_bytes // part_bytes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, ends = batch.column(4).flatten(), np.cumsum(pc.list_value_length(batch.column(4)).to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(batch)), np.diff(np.concatenate([[0], ends])))
            low, high, anchor = (places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high", "anchor"))
            key = [c.take(pa.array(row)) for c in batch.columns[:3]]
            raw, offsets = textbytes.buffers(batch.column(3))
            data, base = memoryview(raw), offsets[row]
            context = pa.array([data[a:b] for a, b in zip((base + low).tolist(), (base + high).tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((anchor % buckets).astype(np.int32)), pa.array((anchor // buckets % parts).astype(np.int32)), *key, pa.array(low), context], ["bucket", "part", *_KEY, "start", "context"])

    def index(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        part = group["part"].to_numpy()
        keys = list(zip(*(group[c].to_pylist() for c in _KEY), strict=True))
        regions = list(zip(keys, group["start"].to_pylist(), group["context"].to_pylist(), strict=True))
        cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        spans = [span for a, b in zip(cut, cut[1:]) for span in repeated_spans(regions[a:b], length)]
        return pa.table({**{c: pa.array([s[0][i] for s in spans], pa.int64()) for i, c in enumerate(_KEY)}, "from": pa.array([s[1] for s in spans], pa.int64()), "to": pa.array([s[2] for s in spans], pa.int64())})

    span_rows = "h1 bigint, h2 bigint, n_bytes bigint, from bigint, to bigint"
    spans = sent.mapInArrow(send, context_rows).groupBy("bucket").applyInArrow(index, span_rows)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                raw = np.frombuffer(batch.column(3)[i].as_py().encode(), np.uint8)
                places = batch.column(4)[i].values
                starts = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(places.field("low").to_pylist(), places.field("high").to_pylist(), strict=True)])
                roll, other = Rolling(raw), Residues(raw)
                key = [pa.array(np.full(len(starts), c[i].as_py()), pa.int64()) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([pa.array(roll.of(starts, starts + length).view(np.int64)), pa.array(other.of(starts, starts + length).view(np.int64)), *key, pa.array(starts)], ["w1", "w2", *_KEY, "start"])

    hot = known.select(*_KEY, "text", F.transform(F.filter("places", lambda p: p["hot"]), lambda p: F.struct(p["low"], p["high"])).alias("at")).filter(F.size("at") > 0)
    strung = hot.mapInArrow(strings, "w1 bigint, w2 bigint, h1 bigint, h2 bigint, n_bytes bigint, start bigint").repartition("w1", "w2")
    twice = strung.groupBy("w1", "w2").agg(F.min(F.struct(*_KEY, "start")).alias("a"), F.max(F.struct(*_KEY, "start")).alias("b")).filter("a <> b").select("w1", "w2")
    spans = spans.union(strung.join(twice, ["w1", "w2"], "left_semi").select(*_KEY, F.col("start").alias("from"), (F.col("start") + length).alias("to")))

    whole = F.transform(F.filter("places", lambda p: p["whole"]), lambda p: F.struct(p["low"].cast("bigint").alias("from"), p["high"].cast("bigint").alias("to")))
    all_of_it = F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), F.array(F.struct(F.lit(0).cast("bigint").alias("from"), F.col("n_bytes").alias("to"))))
    at_once = F.coalesce(all_of_it, whole)
    gathered = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    both = known.select(*_KEY, "text", "copies", F.filter(at_once, lambda s: s["to"] - s["from"] >= length).alias("own")).join(gathered, _KEY, "left")
    joined = F.array_sort(F.concat("own", F.coalesce("spans", F.array().cast("array<struct<from:bigint,to:bigint>>"))))
    return both.withColumn("spans", joined).drop("own").filter(F.size("spans") > 0)


def _removed(found: DataFrame) -> DataFrame:
    """_KEY, n_removed, n_spans, kept_sha256 and kept (the text that is left, as bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(3).to_pylist(), batch.column(4), strict=True):
                data, s = text.encode(), np.array([(x["from"].as_py(), x["to"].as_py()) for x in spans.values], np.int64).reshape(-1, 2)
                reach = np.maximum.accumulate(s[:, 1])
                new = np.append(True, s[1:, 0] > reach[:-1])
                lows, highs = s[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                kept = b"".join(data[a:b] for a, b in zip([0, *highs], [*lows, len(data)], strict=True))
                rows.append((int((highs - lows).sum()), len(lows), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], [*_KEY, "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.select(*_KEY, "text", "spans").mapInArrow(cut, "h1 bigint, h2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length: int = 400, **options: int) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null and short texts lose nothing; repeated rows are equal texts like any
    other; null ids stay null.  Cuts may fall within a character: what is kept is
    judged as bytes.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", *_key_columns(), F.sha2("text", 256).alias("sha256"))
    cut = _removed(find_repeats(docs, text_column=text_column, length=length, **options)).drop("kept")
    return rows.join(cut, _KEY, "left").select(F.col("id").alias(id_column), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, for strings of 400 bytes.

    Null and empty texts have no bytes and the digest of nothing; texts shorter than a
    string lose nothing; equal rows lose all of it where they are long enough; an empty
    table has no rows.  Very long texts are treated whole.
    """
    return remove_repeats(shared.load(spark, sf_dir, "documents"))
