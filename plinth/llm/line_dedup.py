"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

Two lines link when their edit distance (insertions, deletions, substitutions of
characters) is at most `edits`; lines shorter than `min_chars` take no part in
that.  The query and the pipeline also link equal lines of any length but 0
(`shortest`).  A linked class keeps the line that comes first by (id, line number).

1. Lengths are cut into bands.  A band gives edits + 1 segments of equal size, the
   first ones counted from the line's start, the last ones from its end; of a pair
   within the distance one segment of either line stands unchanged in the other,
   moved by no more than the number of segments before it (or behind it).  Keys are
   hashes of (band, number, segment).  For two edits a line has its three segments
   and the middle one moved by one; a line whose partners may be in the band below
   has that band's four keys, too.  Keys are made where lines are read; only hashes
   are shuffled, once for distinct lines and once by key.
2. A key that more than `most_lines` lines have as a segment is a hot one.  Up to
   `crowd` of them are compared where their letter counts are close.  More of them
   meet a pivot first (the most frequent line), then they are cut again: without
   the shared segment (a mark stands for it) and what all of them start and end with,
   what is left must be within the distance, too, so its segments are keys again.
   Lines that link with the pivot are linked with each other through it, and go on
   only where a line is within twice the distance of the pivot.  When little is left,
   lines meet by what they are after the edits (deletions, wildcards), each of these
   groups being linked in a star.  All of it finds the same classes as all pairs do.
3. Candidates are verified with the banded bit-parallel recurrence: 2 edits + 1
   diagonals in a machine word, one step for each character that the two do not share
   at their ends.

A line's identity is its MD5; 64-bit hashes only choose candidates.  Empty tables
give empty results; the length of a line isn't bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared
from plinth.llm.components import components

#: At most so many rows are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: Noncharacters of Unicode, one for each round of cutting: they stand for a segment that was taken out.
_MARKS = [chr(0xFDD0 + k) for k in range(32)]


def _low(size: Column) -> Column:
    """The smallest length in a length's band: bands are 4 wide, from 64 on a sixteenth to an eighth of the length."""
    power = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double") + 0.5)).cast("int")
    width = F.greatest(F.lit(4), F.call_function("shiftleft", F.lit(1), F.greatest(power - 3, F.lit(0))))
    return (size - F.pmod(size, width)).cast("int")

def _moves(edits: int) -> list[tuple[int, int]]:
    """(number, move) of a band's spots: the segments from 1, as they stand (0) and moved."""
    if edits > 4:
        raise ValueError("bands are too narrow for more than four edits")
    most = [min(i - 1, edits + 1 - i) for i in range(1, edits + 2)]
    return [(i, move) for i, m in enumerate(most, 1) for move in range(0 if edits == 2 else -m, m + 1)]


def _with_bands(rows: DataFrame, text: str, edits: int) -> DataFrame:
    """The rows with the text's length (__size), its band's smallest length (__low0) and that of the band below (__low1), null where no partner is there."""
    sized = rows.withColumn("__size", F.length(text)).withColumn("__low0", _low(F.col("__size")))
    below = F.when((F.col("__size") - F.col("__low0") < edits) & (F.col("__low0") > 0), _low(F.col("__low0") - 1))
    return sized.withColumn("__low1", below)


def _spots(edits: int) -> list[dict]:
    """Where a line of _with_bands can share a segment: low (of the band), number, at (from 0), long, own (not moved); low is null where there is none.

    The spots of the line's own band come first, then those of the one below it.
    """
    size, out = F.col("__size"), []
    for low in (F.col("__low0"), F.col("__low1")):
        long = F.floor(low / (edits + 1)).cast("int")
        for i, move in _moves(edits):
            first = long * (i - 1) if i - 1 <= edits + 1 - i else size - long * (edits + 2 - i)
            at = first + move
            fits = (long > 0) & (at + long <= size) & (at >= 0) if move else long > 0
            out.append({"low": F.when(fits, low), "number": i, "at": at.cast("int"), "long": long, "own": move == 0})
    return out


def _key(group: Column, text: Column, spot: dict) -> Column:
    """Null where there is no such segment."""
    segment = F.substr(text, spot["at"] + 1, spot["long"])
    return F.when(spot["low"].isNotNull(), F.xxhash64(group, spot["low"], F.lit(spot["number"]), segment))


def _without(text: Column, spot: dict, mark: str) -> Column:
    """The text with a mark for the segment."""
    return F.concat(F.substr(text, F.lit(1), spot["at"]), F.lit(mark), F.substr(text, spot["at"] + spot["long"] + 1, F.length(text)))


def banded_distance(left: Column, right: Column, edits: int) -> Column:
    """Edit distance of two strings whose lengths differ by `edits` at most; what is above `edits` is only known to be so.

    Column j of the table is held as vertical differences of the rows j - edits to
    j + edits; a step moves the window down one row and along one column.  The
    value is followed down the lowest diagonal to the last row, then along it.
    """
    width = 2 * edits + 1
    bind = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  evaluates value once
    every = F.lit((1 << width) - 1).cast("bigint")
    no = lambda c: F.bitwise_not(c).bitwiseAND(every)

    def step(state: Column, j: Column, a: Column, b: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        same = F.lit(0).cast("bigint")
        for k in range(width):
            row = j - edits + k  # from 1
            hit = F.coalesce((row >= 1) & (F.get(a, row - 1) == F.get(b, j - 1)), F.lit(False))
            same = same.bitwiseOR(F.when(hit, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.struct(vp.alias("vp"), vn.alias("vn"), state["d"].alias("d"), same.alias("x"), j.alias("j"))

    def carry(s: Column) -> Column:
        vp, vn, x = s["vp"], s["vn"], s["x"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(every)
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["d"].alias("d"), s["j"].alias("j"), d0.alias("d0"), vn.bitwiseOR(no(d0.bitwiseOR(vp))).alias("hp"), d0.bitwiseAND(vp).alias("hn"))

    def shift(s: Column, m: Column) -> Column:
        bit = lambda c, k: c.bitwiseAND(k)
        down = s["j"] <= m - edits
        at = F.when(down, F.lit(width - 1)).otherwise(m - s["j"] + edits)
        mask = F.element_at(F.array(*(F.lit(1 << k).cast("bigint") for k in range(width))), at + 1)
        change = F.when(down, (bit(s["d0"], mask) == 0).cast("int")).otherwise((bit(s["hp"], mask) != 0).cast("int") - (bit(s["hn"], mask) != 0).cast("int"))
        half = F.shiftrightunsigned(s["d0"], 1)
        return F.struct(s["hn"].bitwiseOR(no(half.bitwiseOR(s["hp"]))).alias("vp"), half.bitwiseAND(s["hp"]).alias("vn"), (s["d"] + change).alias("d"))

    def distance(pair: Column) -> Column:
        a, b, m, n = pair["a"], pair["b"], F.size(pair["a"]), F.size(pair["b"])
        start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, j: bind(bind(step(s, j, a, b), carry), lambda t: shift(t, m)), lambda s: s["d"])

    return bind(F.struct(F.split(left, "").alias("a"), F.split(right, "").alias("b")), distance)


def _once(value: Column, f) -> Column:
    """f of the value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pair(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))


def common_start(pair: Column) -> Column:
    """How many characters two strings have in common from the start: halving steps, each a comparison of substrings."""
    def step(at: Column, size: Column) -> Column:
        return F.when((at + size <= pair["n"]) & (F.substr(pair["a"], at + 1, size) == F.substr(pair["b"], at + 1, size)), at + size).otherwise(at)

    return F.aggregate(F.filter(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), lambda size: size <= pair["n"]), F.lit(0), step)


def differing(a: Column, b: Column) -> Column:
    """The pair without what it shares at both ends; both strings are turned round."""
    rest = lambda c, n: F.substr(c, n + 1, F.length(c))
    cut = lambda p: _once(common_start(p), lambda n: _pair(F.reverse(rest(p["a"], n)), F.reverse(rest(p["b"], n))))
    last = lambda p: _once(common_start(p), lambda n: _pair(rest(p["a"], n), rest(p["b"], n)))
    return _once(_once(_pair(a, b), cut), last)


def plausible(a: Column, b: Column, edits: int) -> Column:
    """False only for lines that are further apart than two edits: without common ends, two edits are at both ends, and what lies between is equal."""
    if edits != 2:
        return F.lit(True)

    def between(da: int, db: int) -> Column:
        x, y = F.substr(a, F.lit(da + 1), F.length(a)), F.substr(b, F.lit(db + 1), F.length(b))
        return _once(_pair(x, y), lambda p: (F.length(p["a"]) - common_start(p) <= 1) & (F.length(p["b"]) - common_start(p) <= 1))

    return (F.greatest(F.length(a), F.length(b)) <= 16) | between(1, 1) | between(1, 0) | between(0, 1)


def distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings, or any number above `most` where it is above; what they share at their ends, and equal characters before both, leave it as it is."""
    pad = F.lit("#" * most)

    def between(p: Column) -> Column:
        near = (F.abs(F.length(p["a"]) - F.length(p["b"])) <= most) & plausible(p["a"], p["b"], most)
        return F.when(near, banded_distance(F.concat(pad, p["a"]), F.concat(pad, p["b"]), most)).otherwise(most + 1)

    return _once(differing(a, b), between)


def close(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are within the edits."""
    return distance(a, b, edits) <= edits


def _row(id_column: str, text_column: str) -> Column:
    """What tells rows apart: a hash of id and text."""
    return F.xxhash64(F.lit(0), F.col(id_column).isNull(), F.col(id_column), F.col(text_column).cast("string"))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc, row, line_no, line): the lines of every text, numbered from 0."""
    rows = docs.select(F.col(id_column).alias("doc"), _row(id_column, text_column).alias("row"), F.col(text_column).cast("string").alias("text"))
    return rows.select("doc", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


#: Letters whose counts are compared before any text is: an edit changes at most two of them, by one.
_LETTERS = "etaoinrshdlucmgf"


def letter_counts(line: Column, size: Column) -> Column:
    """Counts of sixteen letters, modulo 16, in a bigint, as Gray codes: one more or one less changes one bit."""
    out = F.lit(0).cast("bigint")
    for k, letter in enumerate(_LETTERS):
        n = size - F.length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.cast("bigint").bitwiseAND(F.lit(15).cast("bigint")), 4 * k))
    return _once(out, lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(0x7777777777777777).cast("bigint"))))


def counts_apart(a: Column, b: Column) -> Column:
    """At most this much the two lines' letter counts differ, in sum; never above the truth."""
    return F.bit_count(a.bitwiseXOR(b))


def _few(df: DataFrame, name: str, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows as a written table, to be broadcast if they are `most` at most."""
    table = shared.table(df, name)
    return F.broadcast(table) if table.count() <= most else table


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly: few bytes, but much to compute."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(id, n, k0, k1, ...): distinct lines of (id, line), how often each stands there, and the keys of its spots."""
    spots = _spots(edits)
    names = [f"k{k}" for k in range(len(spots))]
    keyed = _with_bands(lines, "line", edits).select("id", *(_key(F.lit(0), F.col("line"), s).alias(k) for k, s in zip(names, spots, strict=True)))
    return keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *(F.first(k).alias(k) for k in names))


def _by_key(known: DataFrame, edits: int) -> DataFrame:
    """(key, id, n, spot, own): the keys of segment_keys as rows; id is a 64-bit hash of the line's."""
    own = [move == 0 for _, move in _moves(edits)] * 2
    each = F.array(*(F.struct(F.col(f"k{k}").alias("key"), F.lit(k).alias("spot"), F.lit(o).alias("own")) for k, o in enumerate(own)))
    return known.select(F.xxhash64("id").alias("id"), "n", F.inline(each)).filter("key is not null")


def _pairs(rows: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of ids that share a key, at least one of them as its own."""
    own = rows.filter("own").select("key", F.col("id").alias("a"))
    other = rows.filter("not own").select("key", F.col("id").alias("b"))
    same = own.join(own.withColumnRenamed("a", "b"), "key").filter("a < b").select("a", "b")
    moved = other.join(own, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.union(moved).distinct()


def _variants(rows: DataFrame, edits: int) -> DataFrame:
    """(key, id, tag, variant, middle): what texts of at most a dozen characters are after two edits at most.

    Texts within two edits share a variant of which one is the middle, and all texts
    that share a variant are within two edits of its middles: two characters
    replaced, one deleted in both, two deleted in one, one replaced in both and
    one deleted in one.
    """
    if edits != 2:
        raise ValueError("variants are those of two edits")
    t, wild = F.col("tail"), F.lit(chr(0xFFFE))
    places = lambda x: F.when(F.length(x) > 0, F.sequence(F.lit(0), F.length(x) - 1)).otherwise(F.array().cast("array<int>"))
    after = lambda x, i: F.substr(x, i + 2, F.length(x))
    less = lambda x: F.transform(places(x), lambda i: F.concat(F.substr(x, F.lit(1), i), after(x, i)))
    blank = lambda x: F.transform(places(x), lambda i: F.concat(F.substr(x, F.lit(1), i), wild, after(x, i)))
    twice = lambda f, g: F.array_distinct(F.flatten(F.transform(f(t), g)))
    kinds = [
        ("tiny", F.when(F.length(t) <= 2, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), True),
        ("replaced", twice(blank, blank), True),
        ("moved", F.array_distinct(less(t)), True),
        ("deleted", F.array(t), True),
        ("deleted", twice(less, less), False),
        ("mixed", F.array_distinct(blank(t)), True),
        ("mixed", twice(less, blank), False),
    ]

    def named(tag: str, middle: bool):
        return lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("variant"), F.lit(middle).alias("middle"))

    each = F.flatten(F.array(*(F.transform(v, named(tag, middle)) for tag, v, middle in kinds)))
    sized = F.when(F.col("tag") == "moved", F.length("tail")).otherwise(0)
    return rows.select("key", "id", "tail", F.inline(each)).select("key", "id", F.concat("tag", sized.cast("string")).alias("tag"), "variant", "middle")


def _stars(variants: DataFrame) -> DataFrame:
    """(a, b): each text with the smallest middle of each of its variants."""
    middles = variants.filter("middle").groupBy("key", "tag", "variant").agg(F.min("id").alias("a"))
    return variants.join(middles, ["key", "tag", "variant"]).filter("a <> id").select("a", F.col("id").alias("b")).distinct()


def _cut(rows: DataFrame, edits: int, mark: str) -> DataFrame:
    """(key, id, n, rest): rows of (key, id, n, tail) by the keys of their tails' segments, without the segment."""
    tail = F.col("tail")
    each = F.array(*(F.struct(_key(F.col("key"), tail, s).alias("key"), _without(tail, s, mark).alias("rest")) for s in _spots(edits)))
    return _with_bands(rows, "tail", edits).select("id", "n", F.inline(each)).filter("key is not null").select("key", "id", "n", "rest")


def hot_links(rows: DataFrame, edits: int, crowd: int, within: Column, shortest: int = 10) -> list[DataFrame]:
    """(a, b) tables of pairs within the edits that connect all such pairs of rows (key, id, n, rest) of one key.

    In groups of at most `crowd` rows, lines with close letter counts are compared; others meet a pivot, lose what
    they have in common, and are cut into segments again, or into variants where
    at most `shortest` characters, or `edits` more, are left.  `within` tells whether
    a_text and b_text are within the edits.
    """
    found = []
    near = distance(F.col("tail"), F.col("pivot_tail"), 2 * edits)  # built once: it is a large expression
    for mark in _MARKS[1:] * 99:
        rows = shared.table(rows, "hot")
        rest = F.col("rest")
        ends = [F.min(rest).alias("low"), F.max(rest).alias("high"), F.min(F.reverse(rest)).alias("r_low"), F.max(F.reverse(rest)).alias("r_high"), F.min(F.length(rest)).alias("least")]
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.max(F.struct("n", "id", "rest")).alias("pivot"), *ends).filter("lines > 1")
        groups = groups.withColumn("start", common_start(_pair(F.col("low"), F.col("high"))))
        groups = groups.withColumn("end", F.least(common_start(_pair(F.col("r_low"), F.col("r_high"))), F.col("least") - F.col("start")))
        inner = lambda x: F.substr(x, F.col("start") + 1, F.length(x) - F.col("start") - F.col("end"))
        groups = _few(groups.select("key", "lines", "start", "end", F.col("pivot.id").alias("pivot"), inner(F.col("pivot.rest")).alias("pivot_tail")), "groups", 100_000)
        cut = rows.join(groups, "key").withColumn("tail", inner(F.col("rest"))).withColumn("letters", letter_counts(F.col("tail"), F.length("tail")))
        cut = cut.withColumn("pivot_letters", letter_counts(F.col("pivot_tail"), F.length("pivot_tail")))
        apart = counts_apart(F.col("letters"), F.col("pivot_letters"))
        d = F.when(F.col("lines") > crowd, F.when(apart <= 4 * edits, near).otherwise(2 * edits + 1))
        state = F.when(F.col("d").isNull(), 1).when(F.col("d") <= edits, 0).when(F.col("d") <= 2 * edits, 1).otherwise(2)
        met = shared.table(cut.withColumn("d", d).select("key", "id", "n", "tail", "pivot", state.alias("state")), "met")
        found.append(met.filter("state = 0 and id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
        others = F.count(F.when(F.col("state") > 0, 1))
        counts = met.groupBy("key").agg(F.when(F.max(F.when(F.col("state") == 1, 1)).isNotNull(), F.count(F.lit(1))).otherwise(others).alias("left"), others.alias("others"))
        going = _few(counts.filter("others > 0 and left > 1"), "going")
        on = met.join(going, "key").filter("state > 0 or left > others").select("key", "id", "n", "tail", "left")
        small = on.filter(F.col("left") <= crowd).withColumn("letters", letter_counts(F.col("tail"), F.length("tail")))
        small = small.select("key", F.col("id").alias("a"), F.col("tail").alias("a_text"), F.col("letters").alias("a_letters"))
        other = _few(small.toDF("key", "b", "b_text", "b_letters"), "small", 100_000)
        likely = _spread(small).join(other, "key").filter((F.col("a") < F.col("b")) & (counts_apart(F.col("a_letters"), F.col("b_letters")) <= 2 * edits))
        found.append(shared.table(_spread(likely).filter(within).select("a", "b"), "links"))
        large = on.filter(F.col("left") > crowd)
        found.append(shared.table(_stars(_variants(large.filter(F.length("tail") <= shortest + edits), edits)), "stars"))
        rows = _cut(large.filter(F.length("tail") > shortest), edits, mark)
        if large.isEmpty():
            return found
    raise RuntimeError("lines too long to be cut")


def line_links(lines: DataFrame, known: DataFrame, edits: int, most_lines: int, crowd: int) -> DataFrame:
    """(a, b): ids of lines within the edits of each other, as many as connect all such lines; lines has (id, line), known is segment_keys of it."""
    keyed = _by_key(known, edits)
    hot = _few(keyed.filter("own").groupBy("key").agg(F.count(F.lit(1)).alias("lines")).filter(F.col("lines") > most_lines).select("key"), "hot-keys")
    pairs = shared.table(_pairs(keyed.join(hot, "key", "left_anti").select("key", "id", "own")), "pairs")
    crowded = shared.table(keyed.join(hot, "key", "left_semi").select("key", "id", "n", "spot"), "crowded")
    wanted = _few(pairs.select(F.col("a").alias("short")).union(pairs.select("b")).union(crowded.select("id")).distinct(), "wanted")
    texts = shared.table(lines.withColumn("short", F.xxhash64("id")).join(wanted, "short", "left_semi").dropDuplicates(["id"]), "texts", compression="zstd")

    named = texts.withColumn("letters", letter_counts(F.col("line"), F.length("line")))
    a, b = (named.select(F.col("short").alias(x), F.col("id").alias(f"{x}_id"), F.col("line").alias(f"{x}_text"), F.col("letters").alias(f"{x}_letters")) for x in "ab")
    likely = pairs.join(a, "a").join(b, "b").filter(counts_apart(F.col("a_letters"), F.col("b_letters")) <= 2 * edits)
    within = close(F.col("a_text"), F.col("b_text"), edits)
    links = _spread(likely).filter(within).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    if crowded.isEmpty():
        return links

    spots, spot = _spots(edits), F.col("spot")
    of = lambda what: F.coalesce(*(F.when(spot == k, s[what]) for k, s in enumerate(spots)))
    placed = _with_bands(crowded.withColumnRenamed("id", "short").join(texts, "short"), "line", edits)
    placed = placed.withColumn("at", of("at")).withColumn("long", of("long"))
    rest = _without(F.col("line"), {"at": F.col("at"), "long": F.col("long")}, _MARKS[0])
    rows = placed.select("key", "id", "n", rest.alias("rest"))
    for more in hot_links(rows, edits, crowd, within):
        links = links.union(more)
    return links


def line_classes(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", edits: int = 2, min_chars: int = 20, shortest: int | None = None, most_lines: int = 64, crowd: int = 1000
) -> DataFrame:
    """(doc, row, line_no) of the lines to remove: those whose class has an earlier line.

    Null texts have no lines.  Lines under `min_chars` and of `shortest` characters
    or more link with equal ones only; those under both are never removed.  Rows
    without id come first.  Rows of one id and different texts are told apart by
    `row`; equal rows tie, and their lines go or stay together.  `most_lines` is the
    size up to which all lines of a key are compared, `crowd` that up to which those
    with close letter counts are; results depend on neither.
    """
    lines = _lines(docs, id_column, text_column).withColumn("id", F.unhex(F.md5("line")))
    size = F.length("line")
    equal = lines.filter(size >= (min_chars if shortest is None else min(shortest, min_chars)))
    taking = lines.filter(size >= min_chars).select("id", "line")
    known = shared.table(segment_keys(equal.select("id", F.when(size >= min_chars, F.col("line")).alias("line")), edits), "keys", compression="zstd")
    links = shared.table(line_links(taking, known, edits, most_lines, crowd), "links")
    classes = components(links)
    several = known.filter("n > 1").select("id").join(classes, "id", "full").select("id", F.coalesce("component", "id").alias("class"))
    places = equal.select("id", "doc", "row", "line_no").join(_few(several, "several", 200_000), "id")
    first = places.groupBy("class").agg(F.min(F.struct("doc", "line_no", "row")).alias("first"))
    return places.join(first, "class").filter(~F.struct("doc", "line_no", "row").eqNullSafe(F.col("first"))).select("doc", "row", "line_no").distinct()


def drop_repeated_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options: int) -> DataFrame:
    """All rows and columns, without the removed lines in the text column; null texts stay null."""
    gone = line_classes(docs, id_column=id_column, text_column=text_column, **({"shortest": 1} | options)).groupBy(F.col("row").alias("__row")).agg(F.collect_set("line_no").alias("__gone"))
    joined = docs.join(gone, _row(id_column, text_column) == F.col("__row"), "left")
    kept = F.filter(F.split(text_column, "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    return joined.withColumn(text_column, F.when(F.col("__gone").isNull(), F.col(text_column)).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, ascending, comma-joined) of every document."""
    docs = shared.load(spark, sf_dir, "documents").select("doc_id", "text")
    gone = line_classes(docs, shortest=1).groupBy("row").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    lines = docs.select("doc_id", _row("doc_id", "text").alias("row"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines"))
    numbers = F.array_join(F.col("gone").cast("array<string>"), ",")
    return lines.join(gone, "row", "left").select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(numbers, F.lit("")).alias("removed_lines"))
