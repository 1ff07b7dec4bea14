"""Hard negatives by maximum inner product over STR-packed R-trees.

Rows are dealt into slabs by ranges of their first coordinate (equal ones by id, so
copies divide too).  Each slab is packed by sort-tile-recurse, first by label and
then by its coordinates of largest variance, into pages of 256 rows; sixteen
neighbouring nodes make the node above.  A node knows the least and greatest value
of every coordinate, hence an interval that holds the inner products of its rows
with any anchor.  A best-first queue takes the node of the largest upper end; nodes
whose interval misses every score window, or ends strictly below the k-th score
found, are left out.  The pages are a written table.

Anchors meet the slabs in blocks: a task holds one slab (bounded), and anchors pass
it as a stream.  A first pass finds the positives, a second the negatives in the
windows that the positives' scores give; the best of all slabs are the result, so
nothing is approximate.

Defined results.  Rows with null id, label or vector, or a null or non-finite
component take no part, nor do those whose integer vector is longer than 2**31 (no
long could hold their scores).  Of several rows with one id the one with the least
label, then vector, stays.  Vectors of another number of components don't meet.
Ties go to the smaller id.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plinth.llm import shared

PAGE = 256  # rows
FANOUT = 16  # nodes
SLAB = 100_000  # rows at most, about
BLOCK = 200_000  # anchors that pass one copy of a slab, about


# --- rows ---------------------------------------------------------------------------


def integer_vectors(rows: DataFrame, *, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v array<bigint>): rows that take part, each component floor(scale * x)."""
    named = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("bigint").alias("label"), F.col(vector_column).cast("array<double>").alias("x"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    named = named.filter("id is not null and label is not null and x is not null").filter(F.forall("x", finite))
    long = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)))
    named = named.filter(long < 2.0**31 - 1 - F.sqrt(F.size("x")))
    one = named.groupBy("id").agg(F.min(F.struct("label", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))).alias("m"))
    return one.select("id", "m.label", "m.v")


# --- packing --------------------------------------------------------------------------


def str_order(keys: np.ndarray, page: int) -> np.ndarray:
    """Order of the rows by sort-tile-recurse over the columns of `keys`, for pages of `page` rows."""
    pages = -(-len(keys) // page)
    if keys.shape[1] == 1 or pages <= 1:
        return np.argsort(keys[:, 0], kind="stable")
    by = np.argsort(keys[:, 0], kind="stable")
    tile = page * int(np.ceil(pages / np.ceil(pages ** (1 / keys.shape[1]))))
    return np.concatenate([by[k : k + tile][str_order(keys[by[k : k + tile], 1:], page)] for k in range(0, len(by), tile)])


def _pack(levels: int):
    """Pages of one slab: rows of equal length of vector are packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        vectors = table.column("v").chunk(0)
        start = vectors.offsets.to_numpy().astype(np.int64)
        flat, sizes, slab, out = vectors.values.to_numpy(), np.diff(start), TaskContext.get().partitionId(), []
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            at = at[np.argsort(ids[at])]  # rows come from a shuffle in any order
            v = flat[start[at][:, None] + np.arange(size)].reshape(len(at), size)
            wide = np.argsort(-v.astype(float).var(0), kind="stable")[:levels] if size else []
            order = str_order(np.column_stack([labels[at], *(v[:, k] for k in wide)]), PAGE)
            for k in range(0, len(order), PAGE):
                rows = order[k : k + PAGE]
                out.append((slab, size, k // PAGE, ids[at[rows]].tobytes(), labels[at[rows]].tobytes(), v[rows].tobytes()))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["slab", "size", "page", "ids", "labels", "vectors"])

    return run


def pack(rows: DataFrame, slabs: int, *, levels: int = 3) -> DataFrame:
    """(slab, size, page, ids, labels, vectors): the pages of all rows (id, label, v), in the order of each slab's packing."""
    dealt = rows.withColumn("first", F.get("v", F.lit(0))).repartitionByRange(slabs, "first", "id").drop("first")
    return dealt.mapInArrow(_pack(levels), "slab int, size int, page int, ids binary, labels binary, vectors binary")


class Tree:
    """R-tree over one slab's pages of vectors of one size."""

    def __init__(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.pages = [(i, l, v.astype(float)) for i, l, v in pages]
        self.norm = max(float(np.sqrt((v * v).sum(1)).max(initial=0.0)) for _, _, v in self.pages)
        box = lambda parts: (np.array([p[0].min(0) for p in parts]), np.array([p[1].max(0) for p in parts]))
        low, high = box([(v, v) for _, _, v in self.pages])
        labels = np.array([(l.min(), l.max()) for _, l, _ in self.pages])
        self.levels = [(low, high, labels)]
        while len(low) > 1:
            cuts = range(0, len(low), FANOUT)
            low, high = box([(low[k : k + FANOUT], high[k : k + FANOUT]) for k in cuts])
            labels = np.array([(labels[k : k + FANOUT, 0].min(), labels[k : k + FANOUT, 1].max()) for k in cuts])
            self.levels.append((low, high, labels))

    def ends(self, level: int, nodes: slice, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product with q that rows in these nodes can have."""
        low, high, _ = self.levels[level]
        up, down = np.maximum(q, 0.0), np.minimum(q, 0.0)
        return low[nodes] @ up + high[nodes] @ down, high[nodes] @ up + low[nodes] @ down

    def search(self, anchor: int, label: int, q: np.ndarray, same: bool, windows: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each window [low, high] of scores the k best (score, id) among rows of the same label, or of others; smaller ids win ties."""
        exact = self.norm * float(np.sqrt((q.astype(float) ** 2).sum())) < 2.0**52  # sums of doubles are whole numbers then
        qf, best = q.astype(float), [[] for _ in range(len(windows))]
        floor, top = windows[:, 0].astype(float), windows[:, 1].astype(float)  # floor: the k-th score once there are k
        slack = 0.0 if exact else 64.0 + 1e-9 * self.norm * float(np.sqrt((qf * qf).sum()))
        queue = [(-np.inf, len(self.levels), 0)]  # above the top level there is one node
        while queue:
            upper, level, node = heapq.heappop(queue)
            if -upper + slack < floor.min(initial=np.inf):
                break  # all others end lower still
            if level:
                level -= 1
                nodes = slice(node * FANOUT, (node + 1) * FANOUT)
                lower, upper = self.ends(level, nodes, qf)
                span = self.levels[level][2][nodes]
                fits = (span[:, 0] <= label) & (span[:, 1] >= label) if same else (span[:, 0] != label) | (span[:, 1] != label)
                fits &= ((upper[:, None] + slack >= floor) & (lower[:, None] - slack <= top)).any(1)
                for n in np.flatnonzero(fits).tolist():
                    heapq.heappush(queue, (-float(upper[n]), level, nodes.start + n))
                continue
            ids, labels, v = self.pages[node]
            score = v @ qf if exact else (v.astype(np.int64) @ q)
            may = (labels == label) & (ids != anchor) if same else labels != label
            may &= score >= floor.min()
            at = np.flatnonzero(may)
            if not len(at):
                continue
            score, ids = score[at], ids[at]
            for w, (low, high) in enumerate(windows.tolist()):
                inside = np.flatnonzero((score >= max(low, floor[w])) & (score <= high))
                if not len(inside):
                    continue
                if len(inside) > 4 * k:  # only those as good as the k-th of the page can count
                    inside = inside[score[inside] >= np.partition(score[inside], -k)[-k]]
                found = sorted([*best[w], *((-int(s), int(i)) for s, i in zip(score[inside].tolist(), ids[inside].tolist(), strict=True))])[:k]
                best[w] = found
                if len(found) == k:
                    floor[w] = max(floor[w], -found[-1][0])
        return [[(-s, i) for s, i in found] for found in best]


# --- anchors against slabs ----------------------------------------------------------------


def _meet(same: bool, k: int):
    """Streams (pages of a slab, then anchors) to (anchor, window, other, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pages, trees = None, [], {}
        for batch in batches:
            slab, block, page, size, ids, labels, vectors, windows = (c.to_pylist() for c in batch.columns)
            out = []
            for r in range(len(slab)):
                if (slab[r], block[r]) != key:
                    key, pages, trees = (slab[r], block[r]), [], {}
                if page[r] >= 0:
                    pages.append((size[r], np.frombuffer(ids[r], np.int64), np.frombuffer(labels[r], np.int64), np.frombuffer(vectors[r], np.int64).reshape(-1 if size[r] else len(ids[r]) // 8, size[r])))
                    continue
                if pages:  # the first anchor: all pages have come
                    for s in {p[0] for p in pages}:
                        trees[s] = Tree([p[1:] for p in pages if p[0] == s])
                    pages = []
                if size[r] not in trees:
                    continue
                anchor, label = int.from_bytes(ids[r], "little", signed=True), int.from_bytes(labels[r], "little", signed=True)
                asked = np.array(windows[r], np.int64).reshape(-1, 2)
                for w, found in enumerate(trees[size[r]].search(anchor, label, np.frombuffer(vectors[r], np.int64), same, asked, k)):
                    out += [(anchor, w, i, s) for s, i in found]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["anchor", "window", "other", "score"])

    return run


def _binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids, labels and vectors as the bytes that pages hold."""
    for b in batches:
        flat = lambda k: [v.to_bytes(8, "little", signed=True) for v in b.column(k).to_pylist()]  # noqa: B023, E731
        vectors = [np.array(v, np.int64) for v in b.column(2).to_pylist()]
        columns = [pa.array(flat(0), pa.binary()), pa.array(flat(1), pa.binary()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([len(v) for v in vectors], pa.int32()), b.column(0)]
        yield pa.RecordBatch.from_arrays(columns, ["ids", "labels", "vectors", "size", "id"])


def nearest(pages: DataFrame, anchors: DataFrame, slabs: int, blocks: int, *, same: bool, k: int) -> DataFrame:
    """(anchor, window, other, score, place): for each window of each anchor the k best of all slabs.

    anchors: (id, ids, labels, vectors, size, windows array<bigint>), two ends for each window.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    held = pages.select("slab", copies, "page", "size", "ids", "labels", "vectors", F.array().cast("array<bigint>").alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("page"), "size", "ids", "labels", "vectors", "windows")
    together = held.unionByName(asked).repartitionById(slabs * blocks, F.col("slab") * blocks + F.col("block")).sortWithinPartitions("slab", "block", F.expr("page < 0"), "page")
    met = together.mapInArrow(_meet(same, k), "anchor bigint, window int, other bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other"))
    return met.withColumn("place", place).filter(F.col("place") <= k)  # each task keeps k rows before the shuffle


def mine(rows: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v).

    For each anchor (`is_anchor`, over id) and each of its `positives` best rows of
    the same label: the `negatives` best of other labels whose score is at least
    `low` and at most `high` hundredths of the positive's.
    """
    spark = rows.sparkSession
    kept = shared.table(rows, "vectors")
    n = kept.count()
    anchors = kept.filter(is_anchor)
    wanted = max(-(-n // SLAB), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 2_000)), 1)
    blocks = max(1, -(-anchors.count() // BLOCK))
    pages = shared.table(pack(kept, wanted), "pages", compression="zstd")
    slabs = (pages.agg(F.max("slab")).first()[0] or 0) + 1  # as many as were dealt
    asked = shared.table(anchors.select("id", "label", "v").mapInArrow(_binary, "ids binary, labels binary, vectors binary, size int, id bigint"), "anchors")
    every = F.array(F.lit(-(2**62)), F.lit(2**62))
    found = shared.table(nearest(pages, asked.withColumn("windows", every), slabs, blocks, same=True, k=positives), "positives")
    # whole numbers: low * p <= 100 * s <= high * p
    score = F.col("score")
    window = F.array(F.expr(f"cast(ceil(cast(score * cast({low} as decimal(10,0)) as decimal(38,2)) / 100) as bigint)"), F.expr(f"cast(floor(cast(score * cast({high} as decimal(10,0)) as decimal(38,2)) / 100) as bigint)"))
    held = found.filter(score >= 0).select("anchor", "other", "score", "place", window.alias("w"))  # a positive below 0 has no window
    per = held.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score", "w"))).alias("p"))  # at most `positives`
    second = per.join(asked, per.anchor == asked.id).withColumn("windows", F.flatten(F.transform("p", lambda x: x["w"])))
    met = nearest(pages, second.select("id", "ids", "labels", "vectors", "size", "windows"), slabs, blocks, same=False, k=negatives)
    named = met.join(per, "anchor").withColumn("pos", F.element_at("p", F.col("window") + 1))
    return named.select(F.col("anchor").alias("anchor_id"), F.col("pos.other").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("pos.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every row whose id is divisible by 50.

    Labels of ids divisible by 7 move on by one (modulo 10) first.  Rows without a
    usable id, label or vector take no part; ties go to the smaller id; repeated rows
    count once; positives without a row in their window give none.
    """
    rows = integer_vectors(shared.load(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("id") % 50 == 0)


OP13_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
m AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM m WHERE rank <= 3"""
