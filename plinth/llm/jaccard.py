"""N-gram Jaccard join with several global token orders.

A document's set is its distinct word n-grams as 64-bit hashes.  Two sets with a
similarity of at least t = num / den share a token among the first
n - ceil(t n) + 1 of either, in any order of all tokens.  So candidates must share
such a prefix token under every one of several orders, all of them rarest first
and each with ties and steps of its own; the filters are intersected before any
overlap is counted.

1. A sketch of fixed size counts tokens over all documents.  What stands far above
   its median is frequent: it is shared, comes last in every order, and needs no
   exact count, so no token that many documents have is ever gathered.
2. The other tokens meet in buckets by hash, packed by slices of documents, which
   gives each token's exact number of distinct sets.  What goes back to a slice
   are the tokens that several sets have: the only ones that an overlap can hold.
   A set with more tokens of its own than its prefix is long has no candidates.
3. Prefix tokens of the first order link sets to groups (connected components over
   shared tokens, without pairs).  A group's sets meet in blocks of at most
   `block`, each pair of blocks in one task; groups of more than `most_group` sets
   are dealt by prefix token instead.  There the other orders' filters are
   intersected, and overlaps of what is left are counted exactly.
4. A task returns a spanning forest of its links, so a group of n near copies
   gives no more than n - 1 rows a task.  Components are those of the links.

Documents with equal sets are one set (by a 64-bit hash of it) throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared, textbytes
from plinth.llm.components import components

_SLOTS = 21  # log2 of the sketch's counters
_RANGE = 15  # log2 of the counters in one row of the sketch
_ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_FREQUENT = 1 << 24  # counts from here on stand for the sketch's classes


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of word n-grams of all texts in order, number in each); a shorter text is one n-gram, one without words none."""
    raw, offsets = textbytes.buffers(texts)
    raw = textbytes.lower(raw)
    starts, ends, first = textbytes.words(raw, offsets, textbytes.NOT_SPACE)
    h = textbytes.hashes(raw, starts, ends)
    words = np.diff(first)
    size = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    if not len(h):
        return np.zeros(0, np.uint64), size
    at = np.repeat(first[:-1], size) + textbytes.runs(size)
    span = np.repeat(np.minimum(words, n), size)
    out = textbytes.mix(span.astype(np.uint64))
    for k in range(n):
        out = np.where(k < span, textbytes.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + k, len(h) - 1)]), out)
    return out, size


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted distinct n-grams of each text, one text after another; set sizes)."""
    tokens, size = shingles(texts, n)
    row = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((tokens, row))
    tokens, row = tokens[order], row[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    return tokens[new], np.bincount(row[new], minlength=len(size))


def set_hashes(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textbytes.mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)))])
    ends = np.cumsum(size)
    return textbytes.mix(run[ends] - run[ends - size] + size.astype(np.uint64))


def prefix_order(tokens: np.ndarray, counts: np.ndarray, row: np.ndarray, order: int) -> np.ndarray:
    """Positions sorted by row and, in it, by one of the global orders; the second and third take counts in steps."""
    step = counts if order == 0 else np.log2(np.maximum(counts, 1)).astype(np.int64) * order // 2
    return np.lexsort((textbytes.mix(tokens ^ np.uint64(_ORDERS[order])), step, row))


def prefixes(tokens: np.ndarray, counts: np.ndarray, held: np.ndarray, size: np.ndarray, order: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix tokens of each set, their number).

    held: how many tokens of each set are given, which are those that other sets
    have too; the others come before them in every order.
    """
    by = prefix_order(tokens, counts, np.repeat(np.arange(len(held)), held), order)
    take = np.clip(np.where(size > 0, size - (-(-num * size // den)) + 1, 0) - (size - held), 0, held)
    return tokens[by[np.repeat(np.cumsum(held) - held, take) + textbytes.runs(take)]], take


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter of the sketch, 0 for ordinary counts, else the logarithm of how far it is above the median."""
    kind = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**_SLOTS, np.int64)
        for whole in batches:
            for batch in shared.sliced(whole, 0, 6 << 20):
                tokens, _ = shingles(batch.column(0), n)
                total += np.bincount((tokens >> np.uint64(64 - _SLOTS)).astype(np.int64), minlength=len(total))
        for k, part in enumerate(total.reshape(-1, 2**_RANGE)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": [k], "counts": [zstandard.compress(part.astype("<i8").tobytes(), 1)]}, kind)

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(zstandard.decompress(c), "<i8") for c in group["counts"].to_pylist()], 0)
        return pa.Table.from_pydict({"part": [group["part"][0].as_py()], "counts": [total.astype("<i8").tobytes()]}, kind)

    out = np.zeros(2**_SLOTS, np.int64)
    for r in docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # 2 ** _SLOTS numbers, whatever the input
        out[r["part"] << _RANGE : (r["part"] + 1) << _RANGE] = np.frombuffer(r["counts"], "<i8")
    usual = max(1.0, float(np.median(out)))
    return np.where(out > 4 * usual + 16, np.log2(np.maximum(out, 1) / usual) + 1, 0).astype(np.uint8)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, so that the leading bytes of sorted values compress."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


_REQUEST = "bucket bigint, slice bigint, sets binary, sizes binary, held binary, tokens binary"
_REPLY = "slice bigint, sets binary, sizes binary, held binary, tokens binary, counts binary"
_CANDIDATE = "id bigint, n bigint, prefix array<bigint>, tokens binary, counts binary"


def _rows(names: str, columns: list[list]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.table({c.split()[0]: pa.array(v, kinds[c.split()[1]]) for c, v in zip(names.split(", "), columns, strict=True)})


def _requests(texts: pa.Array, n: int, buckets: int, frequent: np.ndarray) -> pa.Table:
    """A slice's distinct sets, their tokens dealt to buckets; frequent tokens go to one of the slice's own."""
    tokens, size = sets(texts, n)
    own = set_hashes(tokens, size)
    _, first = np.unique(own, return_index=True)
    first = first[size[first] > 0]
    at = np.repeat(np.cumsum(size)[first] - size[first], size[first]) + textbytes.runs(size[first])
    tokens, row = tokens[at], np.repeat(np.arange(len(first)), size[first])
    name = int(textbytes.mix(np.bitwise_xor.reduce(textbytes.mix(own[first]), initial=np.uint64(len(first)))).view(np.int64)) if len(first) else 0
    common = frequent[tokens >> np.uint64(64 - _SLOTS)] > 0
    bucket = np.where(common, -1 - (name % 1024), (textbytes.mix(tokens) % np.uint64(buckets)).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    out: list[list] = [[] for _ in range(6)]
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        which, held = np.unique(row[part], return_counts=True)
        for column, value in zip(out, (int(bucket[part[0]]), name, own[first][which].tobytes(), size[first][which].astype("<i4").tobytes(), held.astype("<i4").tobytes(), _pack(tokens[part])), strict=True):
            column.append(value)
    return _rows(_REQUEST, out)


def _replies(group: pa.Table, frequent: np.ndarray) -> pa.Table:
    """The tokens that several distinct sets have, to each slice, with the number of these sets."""
    asked = [(s.as_py(), np.frombuffer(sets_.as_buffer(), "<u8"), np.frombuffer(z.as_buffer(), "<i4"), np.frombuffer(h.as_buffer(), "<i4"), _unpack(t.as_py(), "<u8")) for s, sets_, z, h, t in zip(*(group[c] for c in ("slice", "sets", "sizes", "held", "tokens")), strict=True)]
    tokens = np.concatenate([a[4] for a in asked])
    if group["bucket"][0].as_py() < 0:
        counts = _FREQUENT + frequent[tokens >> np.uint64(64 - _SLOTS)].astype(np.int64)
    else:
        owner = np.concatenate([np.repeat(a[1], a[3]) for a in asked])
        order = np.lexsort((owner, tokens))
        t, o = tokens[order], owner[order]
        new = np.append(True, t[1:] != t[:-1])
        other = new.copy()
        other[1:] |= o[1:] != o[:-1]
        counts = np.empty(len(t), np.int64)
        counts[order] = np.bincount(np.cumsum(new) - 1, weights=other).astype(np.int64)[np.cumsum(new) - 1]
    out: list[list] = [[] for _ in range(6)]
    at = 0
    for name, ids, size, held, own in asked:
        count = counts[at : at + len(own)]
        at += len(own)
        keep = count > 1
        left = np.bincount(np.repeat(np.arange(len(held)), held)[keep], minlength=len(held))
        some = left > 0
        if some.any():
            for column, value in zip(out, (name, ids[some].tobytes(), size[some].tobytes(), left[some].astype("<i4").tobytes(), _pack(own[keep]), _pack(count[keep].astype("<u4"))), strict=True):
                column.append(value)
    return _rows(_REPLY, out)


def _candidates(group: pa.Table, num: int, den: int) -> pa.Table:
    """The sets of a slice whose prefix reaches tokens that others have: all of these, and the prefix's."""
    ids, size, held = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group[c]]) for c, kind in (("sets", "<u8"), ("sizes", "<i4"), ("held", "<i4")))
    tokens = np.concatenate([_unpack(x, "<u8") for x in group["tokens"].to_pylist()])
    counts = np.concatenate([_unpack(x, "<u4") for x in group["counts"].to_pylist()]).astype(np.int64)
    known, first, back = np.unique(ids, return_index=True, return_inverse=True)
    row = np.repeat(back, held)
    order = np.lexsort((tokens, row))
    tokens, counts, row = tokens[order], counts[order], row[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1]))  # another run of the slice asks for the same
    tokens, counts, row = tokens[new], counts[new], row[new]
    held, size = np.bincount(row, minlength=len(known)), size[first].astype(np.int64)
    prefix, take = prefixes(tokens, counts, held, size, 0, num, den)
    end, to = np.cumsum(held), np.cumsum(take)
    some = np.flatnonzero(take)
    return _rows(_CANDIDATE, [known[some].view(np.int64), size[some], [prefix[to[k] - take[k] : to[k]].view(np.int64) for k in some], [tokens[end[k] - held[k] : end[k]].tobytes() for k in some], [counts[end[k] - held[k] : end[k]].astype("<u4").tobytes() for k in some]])


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent, out = list(range(n)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _overlaps(tokens: np.ndarray, size: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """How many tokens each two rows share: products of 0/1 matrices over the tokens that more than one row has."""
    n = len(size)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, n), np.float32)
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    many = count[column] > 1
    _, column = np.unique(column[many], return_inverse=True)
    row = row[many]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, chunk):
        lo, hi = np.searchsorted(column, [at, at + chunk])
        x = np.zeros((n, min(chunk, last - at)), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def links_in_group(tokens: np.ndarray, counts: np.ndarray, held: np.ndarray, size: np.ndarray, part: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Spanning forest of the linked rows; where there are two parts, only rows of different parts are compared."""
    total = size[:, None] + size[None, :]
    ok = np.triu(num * np.maximum(size[:, None], size[None, :]) <= den * np.minimum(size[:, None], size[None, :]), 1)
    if part.any() and not part.all():
        ok &= part[:, None] != part[None, :]
    for order in range(len(_ORDERS)):
        if not ok.any():
            return []
        ok &= _overlaps(*prefixes(tokens, counts, held, size, order, num, den)) > 0
    if not ok.any():
        return []
    both = np.rint(_overlaps(tokens, held)).astype(np.int64)
    return _forest(len(size), np.argwhere(ok & (den * both >= num * (total - both))))


def _link(key: tuple, group: pa.Table, num: int, den: int) -> pa.Table:
    ids = group["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    values, counts = ([group[c][int(k)].as_py() for k in order] for c in ("tokens", "counts"))
    part = (group["own"].to_numpy()[order] == key[2].as_py()) if key[1].as_py() != key[2].as_py() else np.zeros(len(order), bool)
    held = np.array([len(v) // 8 for v in values], np.int64)
    pairs = links_in_group(np.frombuffer(b"".join(values), "<u8"), np.frombuffer(b"".join(counts), "<u4").astype(np.int64), held, group["n"].to_numpy()[order], part, num, den)
    ids = ids[order]
    return pa.table({"a": pa.array([int(ids[a]) for a, _ in pairs], pa.int64()), "b": pa.array([int(ids[b]) for _, b in pairs], pa.int64())})


def jaccard_components(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", n: int = 5, num: int = 80, den: int = 100, block: int = 256, most_group: int = 4096, bucket_tokens: int = 1_000_000) -> DataFrame:
    """(id, n_shingles, component_id) for every row: documents linked at num / den or more are one component, named by its smallest id.

    Null, empty and wordless texts have empty sets and link with nothing.  Rows
    without id count when sets are linked, but have no component.  Rows that
    repeat an id keep their own sets and rows; each gets its set's component.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(rows.select("text"), n))  # of fixed size

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, 1, 6 << 20):
                tokens, size = sets(batch.column(1), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(set_hashes(tokens, size).view(np.int64))], ["id", "n_shingles", "set"])

    known = shared.table(rows.mapInArrow(summary, "id bigint, n_shingles bigint, set bigint"), "sets")
    buckets = max(1, (known.agg(F.sum("n_shingles")).first()[0] or 0) // bucket_tokens)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in shared.sliced(whole, 0, 6 << 20):
                yield from _requests(batch.column(0), n, buckets, frequent.value).to_batches()

    replies = rows.select("text").mapInArrow(ask, _REQUEST).groupBy("bucket").applyInArrow(lambda g: _replies(g, frequent.value), _REPLY)
    found = replies.groupBy("slice").applyInArrow(lambda g: _candidates(g, num, den), _CANDIDATE)
    wanted = shared.table(found.dropDuplicates(["id"]), "candidates", compression="zstd")

    postings = wanted.select("id", F.explode("prefix").alias("token")).repartition("token")
    meeting = postings.groupBy("token").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last").select("token", "least")
    shared_tokens = shared.table(postings.join(meeting, "token").select("token", "id", "least"), "postings")
    groups = shared.table(components(shared_tokens, "id", "least"), "groups")
    grouped = groups.join(groups.groupBy("component").agg(F.count(F.lit(1)).alias("rows")), "component")
    small = grouped.filter(F.col("rows") <= most_group).select("id", F.col("component").alias("place"), "rows")
    large = shared_tokens.join(grouped.filter(F.col("rows") > most_group).select("id"), "id").select("id", F.col("token").alias("place"))
    places = small.unionByName(large.join(large.groupBy("place").agg(F.count(F.lit(1)).alias("rows")), "place"))

    blocks = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")
    dealt = places.select("id", "place", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = dealt.select("id", "place", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(wanted.drop("prefix"), "id")
    links = met.groupBy("place", "i", "j").applyInArrow(lambda k, g: _link(k, g, num, den), "a bigint, b bigint")
    joined = components(links).withColumnRenamed("id", "set")
    labelled = known.join(joined, "set", "left").select("id", "n_shingles", F.coalesce("component", "set").alias("label"))
    linked = labelled.filter("n_shingles > 0 and id is not null")
    names = linked.groupBy("label").agg(F.min("id").alias("name"))
    named = labelled.withColumn("label", F.when(F.expr("n_shingles > 0 and id is not null"), F.col("label"))).join(names, "label", "left")
    return named.select(F.col("id").alias(id_column), "n_shingles", F.coalesce("name", "id").alias("component_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, for sets of four words and a similarity of 0.85.

    Null and wordless texts have empty sets and are their own component, as rows
    without id are; texts of fewer words are one shingle; equal texts link; very long
    texts are taken whole; an empty table has no rows.
    """
    return jaccard_components(shared.load(spark, sf_dir, "documents"), n=4, num=85)


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared_g AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared_g JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM reach WHERE node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
