"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A token is a run of letters and digits (bytes from 0x80 up count as letters) or a
run of other visible characters.  Features are hashed unigrams and bigrams; a
token that follows itself is one bigram whatever the token.  A feature's value is
its share of the text's n-grams, times a constant, so a text's length alone says
nothing.  Scores are sparse dot products: one table look-up for each n-gram.

Training is per-coordinate FTRL-proximal over a bounded sample of labelled rows,
in the order of a hash of the id (`most_rows` of `training_rows` is the bound: the
rows with the smallest hashes).  Features are extracted where the rows are; one task
then makes the passes, and the table of weights has a fixed size (2 ** `bits`
floats), which is what is broadcast for scoring all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.llm import shared, textbytes

_VISIBLE_OTHER = textbytes.NOT_SPACE.copy()
_VISIBLE_OTHER[0x30:0x3A] = _VISIBLE_OTHER[0x41:0x5B] = _VISIBLE_OTHER[0x61:0x7B] = _VISIBLE_OTHER[0x80:] = False
_WORD = textbytes.NOT_SPACE & ~_VISIBLE_OTHER
_SCALE = np.float32(8.0)


def ngrams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the hashed n-grams of all texts, number of them in each text)."""
    raw, offsets = textbytes.buffers(texts)
    parts = [textbytes.words(raw, offsets, c)[:2] for c in (_WORD, _VISIBLE_OTHER)]
    starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    first = np.searchsorted(starts, offsets)
    h = textbytes.hashes(raw, starts, ends)
    pair = np.where(h[1:] == h[:-1], np.uint64(77), textbytes.mix(h[1:] * np.uint64(3) + (h[:-1] >> np.uint64(1))))
    slot = np.uint64(64 - bits)
    both = np.empty(2 * len(h), np.uint32)
    both[::2] = h >> slot
    both[1:-1:2] = pair >> slot if len(h) else 0
    keep = np.ones(len(both), bool)
    keep[2 * first[1:][first[1:] > first[:-1]] - 1] = False  # no bigram goes over the end of a text
    size = np.diff(first)
    return both[keep], np.where(size > 0, 2 * size - 1, 0)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    at = np.concatenate([[0], np.cumsum(size)])
    return total[at[1:]] - total[at[:-1]]


class Ftrl:
    """FTRL-proximal logistic regression; slot 2 ** bits is the constant."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "label", bits: int = 20, passes: int = 5, alpha: float = 1.0, beta: float = 0.1, l1: float = 0.01, l2: float = 0.02) -> np.ndarray:
    """Weights, float32 of length 2 ** bits + 1, from a bounded sample of rows whose label is 0 or 1 (see training_rows).

    Rows without id or label are left out; null texts are empty.  Repeated rows
    count as often as they stand there.  Without rows all weights are 0, and every
    score is 0.5.
    """
    rows = labelled.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("int").alias("label"))
    rows = rows.filter("id is not null and label in (0, 1)").withColumn("turn", F.xxhash64("id"))
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, 0):
                slots, size = ngrams(batch.column(0), bits)
                yield pa.RecordBatch.from_arrays([shared.binaries(slots, np.cumsum(size)), batch.column(1), batch.column(2)], ["slots", "label", "turn"])

    def learn(rows: pa.Table) -> pa.Table:
        model = Ftrl(bits, alpha, beta, l1, l2)
        rows = rows.sort_by([("turn", "ascending"), ("label", "ascending")])
        examples = []
        for slots, label in zip(rows["slots"], rows["label"].to_pylist(), strict=True):
            slot, count = np.unique(np.frombuffer(slots.as_buffer(), np.uint32), return_counts=True)
            examples.append((np.append(slot, np.uint32(2**bits)), np.append(count * (_SCALE / max(1, count.sum())), 1.0).astype(np.float32), label))
        for _ in range(passes):
            for example in examples:
                model.learn(*example)
        return pa.table({"weights": pa.array([model.weights().astype("<f4").tobytes()], pa.binary())})

    found = rows.select("text", "label", "turn").mapInArrow(features, "slots binary, label int, turn bigint")
    learnt = found.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(lambda t: learn(t.select(["slots", "label", "turn"])), "weights binary").first()
    return np.frombuffer(learnt["weights"], "<f4") if learnt else np.zeros(2**bits + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score and predicted for every row, and the columns named in `keep`.

    score is the probability of label 1; null and empty texts get the constant's.
    held_out: crc32 of the id as text leaves 0 modulo 5 (false without id).
    """
    shared_weights = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))
    bits = (len(weights) - 1).bit_length() - 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared_weights.value
        for whole in batches:
            for batch in shared.sliced(whole, 1):
                slots, size = ngrams(batch.column(1), bits)
                at = _sums(w[slots], size) * float(_SCALE) / np.maximum(size, 1) + float(w[-1])
                p = 1.0 / (1.0 + np.exp(-np.clip(at, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), *(batch.column(c) for c in returned)], ["id", "score", *returned])

    same = docs.schema[text_column].dataType == T.StringType()  # then a kept text goes to the workers once
    also = [c for c in keep if not (same and c == text_column)]
    returned = ["text", *(f"keep_{c}" for c in also)] if len(also) < len(keep) else [f"keep_{c}" for c in also]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in also))
    scored = rows.mapInArrow(apply, _with_score(rows, returned))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_column), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(f"keep_{c}" if c in also else "text").alias(c) for c in keep if c != id_column))


def _with_score(rows: DataFrame, returned: list[str]) -> T.StructType:
    by = {f.name: f for f in rows.schema.fields}
    return T.StructType([by["id"], T.StructField("score", T.DoubleType()), *(by[c] for c in returned)])


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """doc_id, text, label of a sample of the labelled rows outside the held-out fold: those with the smallest hashes of the id.

    The sample is drawn from the narrow labels, so it is at most most_rows ids
    that are broadcast, and no text is shuffled.
    """
    known = labels.select("doc_id", F.col("quality").alias("label")).filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("label").isin(0, 1))
    drawn = known.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(most_rows)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null, empty and wordless texts get the score of the model's constant; very long
    texts are scored whole; repeated rows get equal scores, a null id is not held out.
    Of several labels of one id each is a training row.  Without labels every score is
    a half; an empty table has no rows.
    """
    docs = shared.load(spark, sf_dir, "documents")
    return score(docs, train(training_rows(docs, shared.load(spark, sf_dir, "labels"))))


