"""Language-model scores by a hierarchical Pitman-Yor model of word pairs.

Each context word has a restaurant whose customers are the words that follow it;
the tables of all of them are the customers of one parent restaurant over words,
whose base is uniform over the known words and one unknown one.  Seating is
sampled by Gibbs sweeps, restaurants and parent in turn, and the predictive
probabilities of the rounds after a burn-in are averaged.

Spark deals the work.  Slices of documents count their distinct words and word
pairs in training, and send them, packed, to buckets: pairs by a hash of the
context, words by a hash of themselves.  A bucket of pairs merges its counts once
(`_merge`).  A round is two shuffles: the parent's buckets take the tables of
their words from all restaurants, seat them (`_parent`) and answer with the words'
customers and tables there; the restaurants' buckets seat their dishes anew with
the parent's probabilities (`_restaurants`).  Dishes of one customer have one table
for ever, so that only the others have a state.  At last each bucket answers the
slices in the order of their requests, so keys travel once (`_answer`).  No bucket
grows with a word's frequency, only with its distinct neighbours in each slice.

Discounts are one for all restaurants and one for the parent, and a dish's random
numbers come from its own words and the number of the sweep: how many buckets
there are, and which dishes share one, doesn't change a score.

A sweep seats the dishes of all restaurants at once, given the tables of the last
sweep: a dish's customers leave and are seated one after another; those of dishes
with very many in groups that grow with the number seated, within which the
probability of a new table is held.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared, textbytes

_END = np.uint64(0x5851F42D4C957F2D)  # the end of a text, and what stands before its first word
_SHORT = np.uint64(24)  # words are told apart by 40 bits within a context and in the parent


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with one end for each text, number of tokens of each text)."""
    raw, offsets = textbytes.buffers(texts)
    raw = textbytes.lower(raw)
    starts, ends, first = textbytes.words(raw, offsets, textbytes.NOT_SPACE)
    return np.insert(textbytes.hashes(raw, starts, ends), first[1:], _END), np.diff(first) + 1


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte over all values, compressed."""
    v = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.compress(np.ascontiguousarray(v.T).tobytes(), 3)


def _values(data: bytes, width: int) -> np.ndarray:
    v = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((v.shape[1], 8), np.uint8)
    out[:, :width] = v.T
    return out.view("<u8").ravel()


def _series(values: list[np.ndarray]) -> bytes:
    """Arrays of one length that change little from one to the next: the first, then what is added, signs in the lowest bit."""
    first, *later = values
    more = [b - a for a, b in zip(values, later, strict=False)]
    return _planes(np.concatenate([first, *((x << 1) ^ (x >> 63) for x in more)]), 8)


def _from_series(data: bytes, n: int) -> np.ndarray:
    v = _values(data, 8).astype(np.int64).reshape(n, -1)
    v[1:] = (v[1:] >> 1) ^ -(v[1:] & 1)
    return np.cumsum(v, axis=0)


class Slice:
    """Whole texts of about `slice_bytes`: words, pairs, and what is asked for."""

    def __init__(self, batches: list[pa.RecordBatch]):
        self.ids = pa.concat_arrays([b.column(0) for b in batches])
        self.train = np.concatenate([b.column(2).to_numpy(zero_copy_only=False) for b in batches]).astype(bool)
        parts = [_tokens(b.column(1)) for b in batches]
        tokens, self.size = (np.concatenate(x) for x in zip(*parts, strict=True))
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(self.size) - self.size] = _END
        learnt = np.repeat(self.train, self.size)
        self.words, self.at = np.unique(tokens, return_inverse=True)
        self.word_counts = np.bincount(self.at, weights=learnt, minlength=len(self.words)).astype(np.int64)
        whose = np.repeat(np.array(pc.fill_null(self.ids, -1)).astype(np.uint64), self.size)
        place = np.arange(len(tokens), dtype=np.uint64)
        self.name = int(np.bitwise_xor.reduce(textbytes.mix(textbytes.mix(tokens + place) + whose)).view(np.int64))  # equal slices have equal answers
        self.tokens, self.before, self.learnt = tokens, before, learnt

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, word, count in training, index of each token's pair), pairs in order of (context, word)."""
        u = np.searchsorted(self.words, self.before).astype(np.uint64) if len(self.words) else self.before
        key = (u << np.uint64(32)) | self.at.astype(np.uint64)
        pair, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, weights=self.learnt, minlength=len(pair)).astype(np.int64)
        return self.words[(pair >> np.uint64(32)).astype(np.int64)], self.words[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)], count, back


def _slices(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[Slice]:
    held, size = [], 0
    for whole in batches:
        for batch in shared.sliced(whole, 1, slice_bytes // 4):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= slice_bytes:
                yield Slice(held)
                held, size = [], 0
    if held:
        yield Slice(held)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (textbytes.mix(h ^ np.uint64(0x1234567)) % np.uint64(buckets)).astype(np.int64)


def _split(bucket: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((textbytes.mix(h) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def binomial(n: np.ndarray, p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Binomial draws that depend on the 64-bit hashes h alone: inverted sums for means up to 30, a rounded normal beyond."""
    sure, p = p >= 1, np.clip(p, 0.0, 1 - 1e-12)
    mean, u = n * p, _uniform(h)
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(h ^ np.uint64(0x9E3779B97F4A7C15)))
    out = np.where(mean > 30, np.clip(np.rint(mean + normal * np.sqrt(mean * (1 - p))), 0, n), 0.0)
    left = np.flatnonzero(mean <= 30)
    term = np.exp(n[left] * np.log1p(-p[left]))
    total, odds, k = term.copy(), p[left] / (1 - p[left]), 0
    while True:
        more = (u[left] > total) & (k < n[left]) & ((term > 1e-18) | (k < mean[left]))
        left, term, total, odds = left[more], term[more], total[more], odds[more]
        if not len(left):
            return np.where(sure, n, out)
        k += 1
        term = term * odds * (n[left] - k + 1) / k
        total = total + term
        out[left] = k


def reseat(c: np.ndarray, t: np.ndarray, context: np.ndarray, tables: np.ndarray, p: np.ndarray, key: np.ndarray, *, d: float, theta: float, sweep: int) -> np.ndarray:
    """One sweep: new numbers of tables of all dishes, given those of the last sweep.

    c: customers of each dish, 2 at least; t: its tables; context: its restaurant,
    with `tables` in all; p: the parent's probability of it; key: 64 bits of its own.
    """
    order = np.argsort(-c, kind="stable")
    size = c[order]
    others, p, key = (tables[context] - t)[order], p[order], textbytes.mix(key[order] + np.uint64(sweep))
    own, seated, step = np.ones(len(c)), 1, 0
    while n := int(np.searchsorted(-size, -seated)):  # dishes with more customers than are seated
        new = (theta + d * (others[:n] + own[:n])) * p[:n]
        group = np.minimum(size[:n] - seated, max(1, seated // 8))
        step += 1
        own[:n] += binomial(group, new / (new + seated - d * own[:n]), key[:n] + np.uint64(step << 32))
        seated += max(1, seated // 8)
    out = np.empty(len(c), np.int64)
    out[order] = own
    return out


def discount(one: int, two: int) -> float:
    """From the numbers of dishes with one and with two customers."""
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


_PAIRS = "bucket bigint, slice bigint, contexts binary, held binary, words binary, counts binary"
_ROWS = "kind int, bucket bigint, slice bigint, one binary, two binary, three binary"
_NAMES = ["kind", "bucket", "slice", "one", "two", "three"]
# What a row of _ROWS holds, by its kind; the sums of _SUMS are numbers in text.
_ASKED, _DOCS, _SUMS, _CONTEXTS, _DISHES, _SEATS, _TABLES, _SINGLES, _PARENT, _SHARES, _OF_PAIRS, _OF_WORDS = range(12)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, pa.int32() if n == "kind" else pa.int64() if n in ("bucket", "slice") else pa.binary()) for n, c in zip(names, columns, strict=True)})


def _sums(*numbers: int) -> tuple:
    return (_SUMS, -1, None, " ".join(str(int(x)) for x in numbers).encode(), b"", b"")


def _added(table: DataFrame, n: int) -> list[int]:
    """The sums of all buckets, one row to the driver."""
    each = F.split(F.decode("one", "UTF-8"), " ")
    row = table.filter(F.col("kind") == _SUMS).agg(*(F.sum(each[i].cast("bigint")) for i in range(n))).first()
    return [int(x or 0) for x in row]


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder, a folder for each kind, so that a round reads what it needs."""
    path = shared.scratch(df.sparkSession, name)
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(_NAMES)


def _of(table: DataFrame, *kinds: int) -> DataFrame:
    return table.filter(F.col("kind").isin(*kinds))


def _rows(group: pa.Table, kind: int) -> list[tuple]:
    """(bucket, slice, one, two, three) of a kind's rows in order of the slice."""
    own = group.filter(pc.equal(group["kind"], kind)).sort_by("slice")
    return list(zip(*(own[c].to_pylist() for c in _NAMES[1:]), strict=True))


def _ints(data: bytes, width: int = 8) -> np.ndarray:
    return _values(data, width).astype(np.int64)


def _gaps(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=0), 4)


def _to_parent(kind: int, bucket: int, words: np.ndarray, tables: np.ndarray, word_buckets: int) -> list[tuple]:
    """Tables of each word, to the parent's buckets."""
    of = _bucket(words, word_buckets)
    return [(kind, int(of[p[0]]), bucket, _planes(words[p], 5), _planes(tables[p], 8), b"") for p in _split(of)]


def _merge(key: tuple, group: pa.Table, word_buckets: int) -> pa.Table:
    """Counts of a bucket's dishes: what each slice asked for, the restaurants, the dishes that have a state, and first tables."""
    b, group = key[0].as_py(), group.sort_by("slice")
    asked = []
    for s, u, h, w, c in zip(*(group[x].to_pylist() for x in ("slice", "contexts", "held", "words", "counts")), strict=True):
        asked.append((s, _values(u, 8), _ints(h, 4), _values(w, 5), _ints(c, 4)))
    contexts = np.unique(np.concatenate([a[1] for a in asked]))
    where = [np.searchsorted(contexts, a[1]) for a in asked]
    pair = np.concatenate([(np.repeat(i, a[2]).astype(np.uint64) << np.uint64(40)) | a[3] for i, a in zip(where, asked, strict=True)])
    pair, dish = np.unique(pair, return_inverse=True)
    count = np.bincount(dish, weights=np.concatenate([a[4] for a in asked])).astype(np.int64)
    context, word = (pair >> np.uint64(40)).astype(np.int64), pair & np.uint64((1 << 40) - 1)
    many, single = np.flatnonzero(count > 1), np.flatnonzero(count == 1)
    place = np.cumsum(count > 1) - 1
    rows, at = [_sums(len(single), (count == 2).sum())], 0
    for (s, _, held, _, _), i in zip(asked, where, strict=True):
        own = dish[at : at + int(held.sum())]
        at += len(own)
        rows.append((_ASKED, b, s, _planes(count[own], 8), _gaps(place[own][count[own] > 1]), _gaps(i)))
    words, of = np.unique(word[many], return_inverse=True)
    alone = np.bincount(context[single], minlength=len(contexts))
    rows.append((_CONTEXTS, b, None, _planes(contexts, 8), _planes(np.bincount(context[many], minlength=len(contexts)), 4), _planes(alone, 8)))
    same = np.diff(context[many], prepend=-1) == 0
    gaps = of - np.where(same, np.append(0, of[:-1])[: len(of)], 0)  # words ascend within a restaurant
    rows.append((_DISHES, b, None, _planes(words, 5), _planes(gaps, 4), _planes(count[many], 8)))
    rows += _to_parent(_TABLES, b, words, np.bincount(of, minlength=len(words)), word_buckets)
    rows += _to_parent(_SINGLES, b, *np.unique(word[single], return_counts=True), word_buckets)
    return _table(rows, _NAMES)


def _parent(key: tuple, group: pa.Table, number: int, sweeps: int, d: float, theta: float, tables: int, known: int) -> pa.Table:
    """The parent's words of a bucket: customers (the restaurants' tables) and tables, seated anew, and answers to the restaurants' buckets."""
    b = key[0].as_py()
    told, alone = _rows(group, _TABLES), _rows(group, _SINGLES)
    got = [(_values(one, 5), _ints(two)) for _, _, one, two, _ in told + alone]
    words, back = np.unique(np.concatenate([w for w, _ in got]), return_inverse=True)
    c = np.bincount(back, weights=np.concatenate([t for _, t in got])).astype(np.int64)
    t = np.ones(len(c), np.int64)
    for _, _, _, _, last in _rows(group, _PARENT):  # the same words in every round
        t = np.minimum(_ints(last), c)
        many = np.flatnonzero(c > 1)
        for sweep in range(sweeps):
            one = np.zeros(len(many), np.int64)
            t[many] = reseat(c[many], t[many], one, np.array([tables]), np.full(len(many), 1 / (known + 1)), textbytes.mix(words[many]), d=d, theta=theta, sweep=number * sweeps + sweep)
    rows = [_sums(len(c), c.sum(), t.sum(), (c == 1).sum(), (c == 2).sum()), (_PARENT, b, number, _planes(words, 5), _planes(c, 8), _planes(t, 8))]
    at = 0
    for (_, asker, *_), (w, _) in zip(told, got, strict=False):
        i = back[at : at + len(w)]
        at += len(w)
        rows.append((_SHARES, asker, b, _planes(c[i], 8), _planes(t[i], 8), b""))
    if not number and alone:  # tables of one customer, by word, for all rounds
        i = back[at:]
        rows.append((_SINGLES, b, b, _planes(words, 5), _planes(np.bincount(i, weights=np.concatenate([t for _, t in got[len(told) :]]), minlength=len(words)), 8), b""))
    return _table(rows, _NAMES)


class Bucket:
    """The restaurants of a bucket and the dishes with a state."""

    def __init__(self, group: pa.Table):
        _, _, contexts, held, alone = _rows(group, _CONTEXTS)[0]
        _, _, words, gaps, counts = _rows(group, _DISHES)[0]
        self.contexts, self.words, self.word, self.count = _values(contexts, 8), _values(words, 5), np.cumsum(_ints(gaps, 4)), _ints(counts)
        held, self.alone = _ints(held, 4), _ints(alone)
        self.context = np.repeat(np.arange(len(self.contexts)), held)
        self.word -= np.repeat(np.append(0, self.word)[np.cumsum(held) - held], held)

    def tables(self, t: np.ndarray) -> np.ndarray:
        return self.alone + self._sum(t)

    def customers(self) -> np.ndarray:
        return self.alone + self._sum(self.count)

    def _sum(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=x, minlength=len(self.contexts)).astype(np.int64)


def _restaurants(key: tuple, group: pa.Table, number: int, sweeps: int, d: float, theta: float, word_buckets: int, base: tuple) -> pa.Table:
    """A bucket's dishes seated anew with the parent's probabilities; their tables by word go to the parent."""
    b, here = key[0].as_py(), Bucket(group)
    t = np.ones(len(here.count), np.int64)
    for _, _, one, _, _ in _rows(group, _SEATS):
        t = _ints(one)
    answers = {s: (_ints(one), _ints(two)) for _, s, one, two, _ in _rows(group, _SHARES)}
    share, of = np.zeros(len(here.words)), _bucket(here.words, word_buckets)
    for part in _split(of):
        c0, t0 = answers[int(of[part[0]])]
        share[part] = _probability(c0, t0, theta, *base)
    own = textbytes.mix(here.contexts)[here.context] * np.uint64(3) + textbytes.mix(here.words)[here.word]
    for sweep in range(sweeps if len(t) else 0):
        t = reseat(here.count, t, here.context, here.tables(t), share[here.word], own, d=d, theta=theta, sweep=number * sweeps + sweep)
    by_word = np.bincount(here.word, weights=t, minlength=len(here.words)).astype(np.int64)
    return _table([(_SEATS, b, number, _planes(t, 8), b"", b""), *_to_parent(_TABLES, b, here.words, by_word, word_buckets)], _NAMES)


def _probability(c: np.ndarray, t: np.ndarray, theta: float, d: float, known: int, customers: int, tables: int) -> np.ndarray:
    """The parent's predictive probability of words with c customers and t tables there."""
    return (c - d * t + (theta + d * tables) / (known + 1)) / (theta + customers)


def _answer(key: tuple, group: pa.Table) -> pa.Table:
    """For each slice: customers of its dishes, sums of the tables of those with a state over the rounds kept, and its restaurants' customers and tables in each."""
    b, here = key[0].as_py(), Bucket(group)
    seats = [_ints(one) for _, _, one, _, _ in _rows(group, _SEATS)]
    customers, total = here.customers(), np.sum(seats, axis=0)
    tables = [here.tables(t) for t in seats]
    rows = []
    for _, s, counts, places, where in _rows(group, _ASKED):
        where = np.cumsum(_ints(where, 4))
        rows.append((_OF_PAIRS, b, s, counts, _planes(total[np.cumsum(_ints(places, 4))], 8), _series([customers[where], *(t[where] for t in tables)])))
    return _table(rows, _NAMES)


def _words(key: tuple, group: pa.Table, kept: int) -> pa.Table:
    """For each slice: its words' training counts, and their customers and tables in the parent in each round kept."""
    asked = _rows(group, _DOCS)
    full = [_values(one, 8) for _, _, one, _, _ in asked]
    words, back = np.unique(np.concatenate([*full, np.zeros(0, np.uint64)]), return_inverse=True)
    count = np.bincount(back, weights=np.concatenate([*(_ints(two, 4) for _, _, _, two, _ in asked), np.zeros(0)]), minlength=len(words)).astype(np.int64)
    seated = [np.zeros(len(words), np.int64)] * (2 * kept)
    for n, (_, _, one, c, t) in enumerate(_rows(group, _PARENT)):
        known = _values(one, 5)
        at = np.minimum(np.searchsorted(known, words >> _SHORT), len(known) - 1)
        seated[n], seated[kept + n] = (np.where(known[at] == words >> _SHORT, _ints(x)[at], 0) for x in (c, t))
    rows, at = [_sums(count.sum(), (count > 0).sum())], 0
    for (b, s, *_), w in zip(asked, full, strict=True):
        i = back[at : at + len(w)]
        at += len(w)
        rows.append((_OF_WORDS, b, s, _planes(count[i], 8), _series([x[i] for x in seated[:kept]]), _series([x[i] for x in seated[kept:]])))
    return _table(rows, _NAMES)


def pitman_yor_scores(docs: DataFrame, train, *, id_column: str = "doc_id", text_column: str = "text", rounds: int = 5, kept: int = 3, sweeps: int = 2, theta: float = 1.0, slice_bytes: int = 12 << 20, bucket_pairs: int = 1_200_000) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) for every row.

    train: boolean column expression that says which rows are learnt from (null:
    learnt from).  Null and empty texts are one end token.  Every row is a text of
    its own, whatever its id.  With nothing to learn from, words have the uniform
    probability.

    rounds: exchanges between restaurants and parent, of `sweeps` sweeps each; the
    predictive probabilities after each of the last `kept` ones are averaged.
    theta: the concentration of all restaurants.  slice_bytes and bucket_pairs
    bound a task's memory and don't change a score.
    """
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    rows = shared.stable(rows)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, int(size / 6 * 0.65 / bucket_pairs))  # of pairs: about six bytes a word, most pairs distinct in a slice

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, slice_bytes):
            u, w, c, _ = s.pairs()
            out = []
            for part in _split(_bucket(u, buckets)):
                first = np.flatnonzero(np.append(True, u[part][1:] != u[part][:-1]))
                out.append((int(_bucket(u[part[:1]], buckets)[0]), s.name, _planes(u[part][first], 8), _planes(np.diff(np.append(first, len(part))), 4), _planes(w[part] >> _SHORT, 5), _planes(c[part], 4)))
            yield from _table(out, ["bucket", "slice", "contexts", "held", "words", "counts"]).to_batches()

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, slice_bytes):
            bucket = _bucket(s.words >> _SHORT, buckets)
            yield from _table([(_DOCS, int(bucket[p[0]]), s.name, _planes(s.words[p], 8), _planes(s.word_counts[p], 4), b"") for p in _split(bucket)], _NAMES).to_batches()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's documents: ids as Arrow, tokens per text, and tokens as word numbers by falling frequency."""
        for s in _slices(batches, slice_bytes):
            n = np.bincount(s.at, minlength=len(s.words))
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("n", pa.int64())])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([s.ids, pa.array(s.train), pa.array(s.size)], ["id", "train", "n"]))
            yield from _table([(_DOCS, -1, s.name, sink.getvalue().to_pybytes(), _planes(rank[s.at], 4), _planes(s.words[order], 8))], _NAMES).to_batches()

    def grouped(parts: list[DataFrame], work) -> DataFrame:  # noqa: ANN001
        every = functools.reduce(DataFrame.unionByName, parts)
        return every.groupBy("bucket").applyInArrow(work, _ROWS)

    def parent(number: int, d: float, tables: int, known: int, *parts: DataFrame) -> DataFrame:
        return _kept(grouped([_of(start if number else merged, _SINGLES), *parts], lambda k, g: _parent(k, g, number, sweeps, d, theta, tables, known)), "parent")

    def restaurants(number: int, base: tuple, *parts: DataFrame) -> DataFrame:
        return _kept(grouped([_of(merged, _CONTEXTS, _DISHES), *parts], lambda k, g: _restaurants(k, g, number, sweeps, d, theta, buckets, base)), "seated")

    merged = _kept(rows.mapInArrow(ask_pairs, _PAIRS).groupBy("bucket").applyInArrow(lambda k, g: _merge(k, g, buckets), _ROWS), "merged")
    d = discount(*_added(merged, 2))
    above = start = parent(0, 0.0, 0, 0, _of(merged, _TABLES))
    known, customers, tables, *few = _added(above, 5)
    parent_d, last, seats, shares, bases = discount(*few), [], [], [], []
    for number in range(1, rounds + 1):
        below = restaurants(number, (parent_d, known, customers, tables), _of(above, _SHARES), *last)
        above = parent(number, parent_d, tables, known, _of(below, _TABLES), _of(above, _PARENT))
        _, customers, tables, *_ = _added(above, 5)
        last = [_of(below, _SEATS)]
        if number > rounds - kept:
            seats, shares = [*seats, *last], [*shares, _of(above, _PARENT)]
            bases.append(((theta + parent_d * tables) / (known + 1), theta + customers))
    words = _kept(grouped([rows.mapInArrow(ask_words, _ROWS), *shares], lambda k, g: _words(k, g, kept)), "words")
    n, v = _added(words, 2)

    def score(key: tuple, group: pa.Table) -> pa.Table:
        return pa.concat_tables([score_head(group, int(head)) for head in np.flatnonzero(group["kind"].to_numpy() == _DOCS)])

    def score_head(group: pa.Table, head: int) -> pa.Table:
        kind, bucket = group["kind"].to_numpy(), group["bucket"].to_numpy()
        column = {c: group[c] for c in ("one", "two", "three")}
        get = lambda i, c: column[c][int(i)].as_py()
        docs = pa.ipc.open_stream(get(head, "one")).read_all()
        size, ranked = docs["n"].to_numpy(), _values(get(head, "three"), 8)
        rank = _values(get(head, "two"), 4).astype(np.int64)
        s = Slice.__new__(Slice)
        by = np.argsort(ranked)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        s.words, s.at = ranked[by], place[rank]
        s.tokens = s.words[s.at]
        s.before = np.empty_like(s.tokens)
        s.before[1:] = s.tokens[:-1]
        s.before[np.cumsum(size) - size] = _END
        s.learnt = np.zeros(len(s.tokens))
        count, share = np.zeros(len(s.words)), np.zeros((kept, len(s.words)))
        answers = {int(b): i for i, b in zip(np.flatnonzero(kind == _OF_WORDS), bucket[kind == _OF_WORDS], strict=True)}
        for part in _split(_bucket(s.words >> _SHORT, buckets)):
            i = answers[int(_bucket(s.words[part[:1]] >> _SHORT, buckets)[0])]
            count[part] = _values(get(i, "one"), 8)
            share[:, part] = _from_series(get(i, "two"), kept) - parent_d * _from_series(get(i, "three"), kept)
        u, _, _, back = s.pairs()
        own, rest = np.zeros(len(u)), np.zeros((kept, len(u)), np.float32)
        answers = {int(b): i for i, b in zip(np.flatnonzero(kind == _OF_PAIRS), bucket[kind == _OF_PAIRS], strict=True)}
        for part in _split(_bucket(u, buckets)):
            i = answers[int(_bucket(u[part[:1]], buckets)[0])]
            of = np.cumsum(np.append(True, u[part][1:] != u[part][:-1])) - 1
            customers, *tables = _from_series(get(i, "three"), kept + 1)
            c = _ints(get(i, "one"))
            t = (c > 0).astype(float)
            t[c > 1] = _ints(get(i, "two")) / kept
            own[part] = (c - d * t) / (theta + customers)[of]
            rest[:, part] = ((theta + d * np.array(tables)) / (theta + customers))[:, of]
        chance = own[back]
        for part, above, (base, everyone) in zip(rest, share, bases, strict=True):
            chance += part[back] * ((above + base) / everyone)[s.at] / kept
        total = lambda x: np.add.reduceat(x, np.cumsum(size) - size)
        known = count[s.at]
        return pa.table({
            "id": docs["id"], "train": docs["train"], "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(total((known > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(size), int(n)), pa.int64()),
            "base_score": pa.array(total(np.log10((known + 0.5) / (n + 0.5 * (v + 1))))), "score": pa.array(total(np.log10(chance))),
        })

    pairs = grouped([_of(merged, _ASKED, _CONTEXTS, _DISHES), *seats], _answer)
    answers = pairs.unionByName(_of(words, _OF_WORDS)).unionByName(rows.mapInArrow(heads, _ROWS))
    out = answers.groupBy("slice").applyInArrow(score, "id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_column)


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: perplexity of all rows' tokens."""
    return scores.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Null and empty texts are one end token; very long texts are scored whole; repeated
    rows are texts of their own with equal scores; a null id is learnt from; an empty
    table has no rows.
    """
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = pitman_yor_scores(shared.load(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
