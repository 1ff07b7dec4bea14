"""Operators on texts: brute force on small tables with nulls, empties, long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import decontaminate, jaccard, line_dedup, pitman_yor, quality, shared, suffix_dedup, textbytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, id string, a string, key int"


def frame(spark, rows, parts=3):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(parts)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(LOWER))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(["der", "Zug", "fährt", "heute", "nicht", "nach", "Bern,", "weil", "Schnee", "liegt."]) + str(rng.integers(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    a, b = prose(1, 120), prose(2, 300)
    near = a.split()
    near[50] = "anders"
    return [
        (1, a), (2, " ".join(near)), (3, a), (4, b), (5, b + " " + prose(3, 4)), (6, None), (7, ""), (8, " \n\t "), (9, "kurz"), (10, "kurz"), (11, "ein ZWEI drei"), (12, "Ein zwei Drei"),
        (13, prose(4, 8000)), (14, prose(5, 30) + " " + a), (15, "x" * 5000), (15, "x" * 5000), (None, a), (16, "wort " * 900), (17, b[:900] + "\n" + prose(6, 50)), (18, "é" * 700),
    ]


def test_word_kernel():
    texts = ["a bc  d", None, "", "é\x00ü x", "w" * 3000 + " w", " \x0b"]
    raw, offsets = textbytes.buffers(pa.array(texts))
    starts, ends, first = textbytes.words(raw, offsets, textbytes.NOT_SPACE)
    found = [bytes(raw[s:e]).decode() for s, e in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(np.diff(first)) == [3, 0, 0, 2, 2, 0]
    h = textbytes.hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(set(found))


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_jaccard(spark, rows, n, num):
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows), n=n, num=num, den=100, block=2, bucket_tokens=500).collect()), key=str)
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            label = [label[i] if x == label[j] else x for x in label]
    ids = [i for i, _ in rows]
    name = {k: min((ids[i] for i in range(len(rows)) if label[i] == label[k] and ids[i] is not None), default=None) for k in range(len(rows))}
    want = sorted(((ids[k], len(sets[k]), name[k] if sets[k] and ids[k] is not None else ids[k]) for k in range(len(rows))), key=str)
    assert got == want


def test_jaccard_by_token_and_blocks(spark):
    base = prose(7, 200).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 5):
            w[(37 * i + 61 * k) % len(w)] = f"neu{i}_{k}"
        rows.append((i, " ".join(w)))
    want = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows), block=7, most_group=10, bucket_tokens=900).collect()}
    assert got == want and set(want.values()) == {0}


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(frame(spark, [(1, "a")]).limit(0)).count() == 0


def removed(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"most_contexts": 1}, {"bucket_bytes": 5000}])
def test_suffix_dedup(spark, rows, options):
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=400, **options).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 400)


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("options", [{}, {"most_contexts": 1}])
def test_suffix_dedup_of_texts_that_polynomials_modulo_powers_of_two_confuse(spark, options):
    rows = [(1, thue_morse(4096, "a", "b")), (2, thue_morse(4096, "b", "a")), (3, "x" + thue_morse(2048, "a", "b") + prose(3, 90)), (4, thue_morse(512, "a", "b")), (5, thue_morse(512, "b", "a"))]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=400, **options).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 400)
    half = np.frombuffer((thue_morse(1024, "a", "b") + thue_morse(1024, "b", "a")).encode(), np.uint8)
    at = np.array([0, 1024])
    one, two = suffix_dedup.Residues(half).of(at, at + 1024)
    assert one != two


def test_planted_passages_are_removed_where_they_repeat(spark):
    """Read by n_removed: passages of 400 bytes or more go from all their places, shorter ones and what is clean stay."""
    long, short = prose(50, 80), prose(51, 30)
    assert len(long.encode()) >= 400 > len(short.encode()) + 2
    rows = [(i, prose(100 + i, 150) + " \n" + (long if i % 3 == 0 else short if i % 3 == 1 else "") + "\n " + prose(200 + i, 150)) for i in range(24)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(frame(spark, rows), length=400).collect()}
    for i in range(24):
        assert (got[i] >= len(long.encode()) and got[i] <= len(long.encode()) + 40) if i % 3 == 0 else got[i] == 0


@pytest.mark.parametrize("options", [{"part_bytes": 1000}, {"bucket_bytes": 5000, "part_bytes": 700}])
def test_suffix_dedup_by_parts_of_buckets(spark, rows, options):
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=400, **options).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, 400)


def test_surroundings_hold_the_strings_of_one_anchor():
    """Each string is in one anchor's surroundings, wherever its text stands in a batch; nothing is hashed or indexed for two anchors."""
    texts = [prose(60, 400), "a" * 1500, prose(61, 20), "", prose(60, 400)[700:2000], "ab" * 200]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    raw = np.frombuffer(data, np.uint8)
    at, low, high = suffix_dedup.anchors(raw, offsets, suffix_dedup.Rolling(raw), 400)
    starts = np.concatenate([np.arange(a, b - 399) for a, b in zip(low, high, strict=True)])
    assert starts.tolist() == [p for a, b in itertools.pairwise(offsets.tolist()) for p in range(a, b - 399)]
    chosen = {}
    for k, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
        assert a <= k <= b - 32
        for p in range(a, b - 399):
            assert p <= k <= p + 400 - 32 and chosen.setdefault(data[p : p + 400], k - p) == k - p


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_run_length_index():
    rng = np.random.default_rng(3)
    for size in (1, 5, 200, 3000):
        text = rng.choice(list(b"ab"), size).astype(np.uint8).tobytes() + rng.choice(list(b"abcd\0"), size).astype(np.uint8).tobytes() * 2
        index = suffix_dedup.RunLengthIndex(np.frombuffer(text, np.uint8))
        assert index.suffixes.tolist() == sorted(range(len(text)), key=lambda i: text[i:]) if size <= 200 else True
        n = 12
        count = collections.Counter(text[i : i + n] for i in range(len(text) - n + 1))
        want = [i + n <= len(text) and count[text[i : i + n]] > 1 for i in range(len(text))]
        got = index.repeated(n)
        assert got[: len(text) - n + 1].tolist() == want[: len(text) - n + 1]


def within(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] <= k


def test_lines(spark):
    line = "die gleiche Zeile mit genug Zeichen"
    rows = [
        (2, f"{line}\nkurz\n{line}!"), (1, f"eigen {line}\n{line}\nkurz"), (3, None), (4, ""), (5, line.replace("gleiche", "gleihce")), (6, line.replace("genug", "wenig ")),
        (7, "é" * 25 + "\n" + "é" * 24 + "e"), (8, "z" * 9000), (8, "z" * 9000), (None, line + "??"), (9, f"\n\n{line}\n"),
    ]
    docs = frame(spark, rows)
    got = {(r.doc, r.line_no) for r in line_dedup.line_classes(docs).collect()}
    lines = sorted([(i if i is not None else -1, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))], key=lambda x: x[:2])
    taking = [x for x in lines if len(x[2]) >= 20]
    label = list(range(len(taking)))
    for i, j in itertools.combinations(range(len(taking)), 2):
        if within(taking[i][2], taking[j][2], 2):
            label = [label[i] if x == label[j] else x for x in label]
    first, want = {}, set()
    for k, (i, n, _) in enumerate(taking):
        if first.setdefault(label[k], (i, n)) != (i, n):
            want.add((i if i >= 0 else None, n))
    assert got == want
    cut = line_dedup.drop_repeated_lines(docs)
    kept = {r.doc_id: r.text for r in cut.collect()}
    assert kept[9] == "\n\n" and kept[3] is None and kept[4] == "" and cut.columns == docs.columns


def test_short_lines_go_where_they_are_equal(spark):
    rows = [(1, "Les.\nneu\n\n"), (2, "neu\nLes.\n\nLet.\nLes."), (3, None), (4, "x" * 19), (5, "x" * 19), (6, "x" * 20)]
    kept = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(frame(spark, rows)).collect()}
    assert kept == {1: "Les.\nneu\n\n", 2: "\nLet.", 3: None, 4: "x" * 19, 5: "", 6: "x" * 20}
    path = shared.scratch(spark, "sf")
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.removed_lines) for r in line_dedup.op1_line_dedup(spark, path).collect()}
    assert got == {1: (0, ""), 2: (3, "0,1,4"), 3: (0, ""), 4: (0, ""), 5: (1, "0"), 6: (0, "")}


def classes_of(lines, edits=2):
    """The smallest line of each class, by brute force."""
    label = list(range(len(lines)))
    for i, j in itertools.combinations(range(len(lines)), 2):
        if label[i] != label[j] and abs(len(lines[i]) - len(lines[j])) <= edits and within(lines[i], lines[j], edits):
            label = [label[i] if x == label[j] else x for x in label]
    return label


def edited(rng, line, times):
    line = list(line)
    for _ in range(times):
        at = int(rng.integers(0, len(line) + 1))
        kind = rng.integers(0, 3)
        line[at : at + int(kind > 0)] = [str(rng.choice(list("abé7 ")))] * int(kind != 2)
    return "".join(line)


def crowded(seed):
    """Lines with segments in common: copies with edits, chains of edits, numbers in a form, words changed."""
    rng = np.random.default_rng(seed)
    base = [prose(seed, 6), prose(seed + 1, 12), "ab" * 14, "x" * 30]
    lines = [edited(rng, b, int(rng.integers(0, 6))) for b in base for _ in range(40)]
    for _ in range(40):
        lines.append(edited(rng, lines[-1], 2))
    form = prose(seed + 2, 9)
    lines += [f"{form} {rng.integers(0, 10 ** int(rng.integers(1, 7)))} {form[:20]}" for _ in range(90)]
    for _ in range(60):
        w = form.split()
        w[int(rng.integers(0, len(w)))] = str(rng.choice(["Rad", "Bad", "Wetter", "Fahrt", "Anfang"]))
        lines.append(" ".join(w))
    return sorted({x for x in lines if len(x) >= 20})


@pytest.mark.parametrize("seed, most_lines, crowd", [(1, 2, 4), (3, 1000, 1000)])
def test_links_of_crowded_segments_connect_what_all_pairs_do(spark, seed, most_lines, crowd):
    lines = crowded(seed)
    frame_ = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("id", F.unhex(F.md5("line")))
    known = shared.table(line_dedup.segment_keys(frame_, 2), "keys")
    links = line_dedup.line_links(frame_, known, 2, most_lines, crowd).collect()
    index = {hashlib.md5(x.encode()).digest(): i for i, x in enumerate(lines)}
    label = list(range(len(lines)))
    for r in links:
        i, j = index[bytes(r.a)], index[bytes(r.b)]
        assert within(lines[i], lines[j], 2)
        if label[i] != label[j]:
            label = [label[i] if x == label[j] else x for x in label]
    want = classes_of(lines)
    group = lambda label: {frozenset(i for i, x in enumerate(label) if x == y) for y in label}
    assert group(label) == group(want) and len(group(want)) > 5


@pytest.mark.parametrize("most", [2, 4])
def test_distance(spark, most):
    rng = np.random.default_rng(5)
    pairs = [(x, edited(rng, x, int(rng.integers(0, 7)))) for x in ("", "a", "abba", "ab" * 20, prose(8, 9)) for _ in range(40)]
    got = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "a string, b string, i int").select("i", line_dedup.distance(F.col("a"), F.col("b"), most).alias("d")).collect()
    for r in got:
        a, b = pairs[r.i]
        want = next((k for k in range(most + 1) if within(a, b, k)), None)
        assert r.d == want if want is not None else r.d > most, pairs[r.i]


def test_line_plan_is_native(spark, rows):
    """Neither the keys' side nor the hot segments' side has a Python worker."""
    lines = frame(spark, rows).select(F.col("text").alias("line"), F.unhex(F.md5("text")).alias("id"))
    known = line_dedup.segment_keys(lines, 2)
    hot = line_dedup._by_key(known, 2).select("key", F.col("id").cast("string").cast("binary").alias("id"), "n", F.lit("abc").alias("rest"))
    cut = line_dedup._variants(line_dedup._cut(hot.withColumnRenamed("rest", "tail"), 2, "|").withColumnRenamed("rest", "tail"), 2)
    for plan in (line_dedup._pairs(line_dedup._by_key(known, 2)), line_dedup._stars(cut), line_dedup.line_classes(frame(spark, rows))):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_decontamination(spark, rows):
    a = rows[0][1]
    bench = spark.createDataFrame([(1, a[:300], 0), (12, "ein zwei, drei", 0), (5, "ein-zwei", 0), (7, None, 0), (8, "...", 0), (None, a, 0), (3, " ".join(["wort"] * 10), 0), (2, prose(9, 40), 0), (2, prose(9, 40), 0)], "item_id bigint, text string, id int")
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [(r.item_id, words(r.text, pattern)) for r in bench.collect() if r.item_id is not None]
    for blocks in (2_000_000, 20):
        docs = frame(spark, rows)
        found = decontaminate.find(docs, decontaminate.Index(docs, bench, block_words=blocks, piece_words=13), keep=("text",)).collect()
        assert len(found) == len(rows)
        for r in found:
            w = words(r.text, pattern)
            hit, names = set(), set()
            for item, own in items:
                n = min(10, len(own))
                grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in grams:
                        hit |= set(range(k, k + n))
                        names.add(item)
            covered = {p for lo, hi in zip(r.spans[::2], r.spans[1::2], strict=True) for p in range(lo, hi)}
            assert (r.n_words, covered, r["items"]) == (len(w), hit, sorted(names))


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, None)])
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    got = decontaminate.proximity_matches(docs, decontaminate.Index(docs, bench), terms=3, within=6).collect()
    assert [(r.id, r.item) for r in got] == [(1, 1)]


def test_no_benchmark(spark, rows):
    docs = frame(spark, rows)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find(docs, decontaminate.Index(docs, empty)).filter("size(spans) > 0").count() == 0
    assert decontaminate.find(docs.limit(0), decontaminate.Index(docs.limit(0), empty)).count() == 0


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(quality.training_rows(docs, labels))).join(labels, "doc_id").filter("held_out and quality is not null").toPandas()
    good, bad = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    assert len(bad) > 3 and np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :]) > 0.97


def test_quality_edges(spark, rows):
    docs = frame(spark, rows)
    nothing = quality.train(docs.selectExpr("doc_id", "text", "cast(null as int) label"), bits=10)
    got = quality.score(docs, nothing, keep=("a", "key")).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5} and {r.a for r in got} == {"y"}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.score(docs.limit(0), nothing).count() == 0


def test_language_model(spark, rows):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = pitman_yor.pitman_yor_scores(frame(spark, rows), ~held, slice_bytes=20_000, bucket_pairs=300).collect()
    texts = [(i, [*words(t), None], not (i is not None and zlib.crc32(str(i).encode()) % 5 == 1)) for i, t in rows]
    count = collections.Counter(w for _, t, learnt in texts if learnt for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted(((i, len(t), sum(count[w] > 0 for w in t), n, round(float(sum(np.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)), 6)) for i, t, _ in texts), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_is_a_distribution(spark):
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a", "a a b", "c"])]
    every = [f"a {w}" for w in ("a", "b", "c", "zzz")] + ["a"]
    docs = frame(spark, rows + [(100 + i, t) for i, t in enumerate(every)])
    scores = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(docs, F.col("doc_id") < 100).collect()}
    # after "a": each word and the end share probability one; "a" alone is "a" and the end
    start = {r.doc_id: r.score for r in pitman_yor.pitman_yor_scores(frame(spark, rows + [(100, "")]), F.col("doc_id") < 100).collect()}[100]
    assert start < 0 and all(scores[100 + i] < 0 for i in range(len(every)))
    assert scores[100] > scores[103]  # a known word is likelier than an unknown one


def test_language_model_sums_to_one(spark):
    """The probabilities of all texts: those of up to six words of two known words and an unknown one are nearly all of them."""
    learnt = ["", "a", "b", "a b", "", "a", "b", ""] * 4
    every = [" ".join(w) for n in range(7) for w in itertools.product(("a", "b", "zzz"), repeat=n)]
    docs = frame(spark, [*enumerate(learnt), *((1000 + i, t) for i, t in enumerate(every))])
    total = {n: 0.0 for n in range(7)}
    for r in pitman_yor.pitman_yor_scores(docs, F.col("doc_id") < 1000).collect():
        if r.doc_id >= 1000:
            total[r.n_tokens - 1] += 10**r.score
    assert 0.98 < sum(total.values()) <= 1 + 1e-6 and all(total[n] > total[n + 1] for n in range(1, 6))


def test_language_model_of_nothing(spark):
    assert pitman_yor.pitman_yor_scores(frame(spark, [(1, "a")]).limit(0), F.lit(True)).count() == 0
    got = pitman_yor.pitman_yor_scores(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 3, 2: 1} and all(r.train_tokens == 0 and np.isfinite(r.score) for r in got)


def plain_ftrl(examples, dims, alpha, beta, l1, l2):
    """The published update, one example and one feature at a time."""
    z, n = np.zeros(dims), np.zeros(dims)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)

    for features, label in examples:
        w = {i: weight(i) for i in features}
        p = 1 / (1 + np.exp(-sum(w[i] * x for i, x in features.items())))
        for i, x in features.items():
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    return np.array([weight(i) for i in range(dims)])


def test_training_is_the_published_update(spark, rows):
    """Rows of two labels and repeated ids among them; the order is that of the ids' hashes, then of the labels."""
    labelled = [(i, t, k % 2) for k, (i, t) in enumerate(rows)] + [(2, rows[1][1], 0), (2, rows[1][1], 1)]
    frame_ = spark.createDataFrame(labelled, "doc_id bigint, text string, label int").filter("doc_id <> 15").repartition(3)
    options = dict(alpha=0.7, beta=0.2, l1=0.01, l2=0.05)
    got = quality.train(frame_, bits=8, passes=2, **options)
    turns = frame_.filter("doc_id is not null").withColumn("turn", F.xxhash64(F.col("doc_id").cast("string"))).orderBy("turn", "label").collect()
    examples = []
    for r in turns:
        slots, _ = quality.ngrams(pa.array([r.text], pa.string()), 8)
        count = collections.Counter(slots.tolist())
        examples.append(({**{i: np.float32(n * (np.float32(8.0) / max(1, len(slots)))) for i, n in count.items()}, 256: 1.0}, r.label))
    want = plain_ftrl(examples * 2, 257, **options)
    assert np.allclose(got, want, atol=1e-4) and np.count_nonzero(want) > 50


def test_seating_is_within_bounds():
    c, context, word = np.array([2, 2, 2, 5, 100, 20_000]), np.array([0, 0, 0, 1, 1, 1]), np.arange(6, dtype=np.uint64)
    seated = []
    for _ in range(2):
        t = np.ones(6, np.int64)
        for sweep in range(6):
            t = pitman_yor.reseat(c, t, context, np.bincount(context, weights=t), np.full(6, 1 / 6), word, d=0.5, theta=1.0, sweep=sweep)
            assert (t >= 1).all() and (t <= c).all()
        seated.append(t)
    assert (seated[0] == seated[1]).all() and seated[0][5] > 1


def test_binomial_draws():
    for n, p in ((1, 0.3), (7, 0.9), (40, 0.01), (1000, 0.02), (5000, 0.4), (3, 0.0), (3, 1.0)):
        got = pitman_yor.binomial(np.full(200_000, n), np.full(200_000, p), np.arange(200_000, dtype=np.uint64))
        sd = np.sqrt(n * p * (1 - p))
        assert (got >= 0).all() and (got <= n).all()
        assert abs(got.mean() - n * p) <= 5 * sd / np.sqrt(len(got)) + 1e-9 and abs(got.std() - sd) <= 0.02 * sd + 1e-6


def test_tables_of_two_customers_are_gibbs_draws():
    """Two customers sit apart with odds of (theta + d (others + 1)) p to 1 - d: the conditional of one dish given the rest."""
    n, d, theta, p, others = 100_000, 0.4, 1.5, 0.3, 4
    t = pitman_yor.reseat(np.full(n, 2), np.ones(n, np.int64), np.arange(n), np.full(n, others + 1), np.full(n, p), np.arange(n, dtype=np.uint64), d=d, theta=theta, sweep=3)
    apart = (theta + d * (others + 1)) * p
    assert abs((t == 2).mean() - apart / (apart + 1 - d)) < 0.01


def test_scores_do_not_depend_on_buckets_or_slices(spark, rows):
    scores = [
        {(r.doc_id, r.n_tokens, r.score) for r in pitman_yor.pitman_yor_scores(frame(spark, rows), F.col("doc_id") % 5 != 1, slice_bytes=size, bucket_pairs=pairs).collect()}
        for size, pairs in ((12 << 20, 1_200_000), (20_000, 300), (50_000, 70))
    ]
    assert scores[0] == scores[1] == scores[2]


def customers_one_by_one(pairs, sweeps, burn_in, d, parent_d, theta, seed):
    """Plain sampler: customers leave and come back one at a time, and so do their tables above; mean predictive of each (context, word)."""
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for _, w in pairs})
    below, above = collections.defaultdict(list), {w: [] for w in vocabulary}  # sizes of tables

    def p(w):
        total, tables = sum(map(sum, above.values())), sum(map(len, above.values()))
        return (sum(above[w]) - parent_d * len(above[w]) + (theta + parent_d * tables) / (len(vocabulary) + 1)) / (theta + total)

    def restaurant(u):
        return sum(sum(below[u, w]) for w in vocabulary), sum(len(below[u, w]) for w in vocabulary)

    def pick(tables, off, new):
        weights = np.array([n - off for n in tables] + [new])
        return int(rng.choice(len(weights), p=weights / weights.sum()))

    def sit(u, w):
        at = pick(below[u, w], d, (theta + d * restaurant(u)[1]) * p(w))
        if at < len(below[u, w]):
            below[u, w][at] += 1
            return
        below[u, w].append(1)
        up = pick(above[w], parent_d, (theta + parent_d * sum(map(len, above.values()))) / (len(vocabulary) + 1))
        above[w][up : up + 1] = [above[w][up] + 1] if up < len(above[w]) else [1]

    def leave(tables):
        at = int(rng.choice(len(tables), p=np.array(tables) / sum(tables)))
        tables[at] -= 1
        return not tables[at] and not tables.pop(at)

    for u, w in pairs:
        sit(u, w)
    mean = collections.Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(below[u, w]):
                leave(above[w])
            sit(u, w)
        if sweep >= burn_in:
            for u in {u for u, _ in pairs}:
                n, tables = restaurant(u)
                for w in vocabulary:
                    mean[u, w] += (sum(below[u, w]) - d * len(below[u, w]) + (theta + d * tables) * p(w)) / (theta + n) / (sweeps - burn_in)
    return mean


def test_language_model_agrees_with_a_plain_sampler(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcde"), p=[0.4, 0.3, 0.15, 0.1, 0.05], size=rng.integers(1, 9))) for _ in range(40)]
    tokens = [[*words(t), None] for t in texts]
    pairs = [(u or "", w or "") for t in tokens for u, w in zip([None, *t], t, strict=False)]
    counts = collections.Counter(pairs)
    d = pitman_yor.discount(*(sum(c == k for c in counts.values()) for k in (1, 2)))
    contexts = collections.Counter(w for _, w in counts)
    parent_d = pitman_yor.discount(*(sum(c == k for c in contexts.values()) for k in (1, 2)))
    mean = customers_one_by_one(pairs, 60, 20, d, parent_d, 1.0, 1)
    got = pitman_yor.pitman_yor_scores(frame(spark, list(enumerate(texts))), F.lit(True), rounds=14, kept=10).collect()
    for r in got:
        t = ["", *(w or "" for w in tokens[r.doc_id])]
        want = sum(np.log10(mean[u, w]) for u, w in zip(t, t[1:], strict=False))
        assert abs(r.score - want) < 0.03 * r.n_tokens
