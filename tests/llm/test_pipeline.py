"""The pipeline's stages on the small tables, each held against a plain version of what it decides."""

import itertools
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as p
from plinth.llm import line_dedup, shared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in p.STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), f"test-{name}")
        out.append(docs)
    return [{r.doc_id: r for r in d.collect()} for d in out], [d.columns for d in out]


def grams(text, n, pattern):
    w = re.findall(pattern, (text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_columns_and_rows(stages):
    rows, columns = stages
    assert all(c == p.COLUMNS for c in columns[1:5]) and columns[5][:5] == p.COLUMNS
    for before, after in itertools.pairwise(rows):
        assert set(after) <= set(before)
    assert set(rows[2]) == set(rows[1]) and set(rows[5]) == set(rows[4])


def test_quality_keeps_most_good_rows(stages, spark, sf_dir):
    rows, _ = stages
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1 and i in rows[0]]
    assert sum(i in rows[1] for i in good) >= 0.95 * len(good)
    assert all(rows[1][i].text == rows[0][i].text for i in rows[1])


def test_lines_are_kept_in_order(stages):
    rows, _ = stages
    seen = set()
    for i in sorted(rows[2]):
        after, before = (rows[2][i].text or "").split("\n"), iter((rows[1][i].text or "").split("\n"))
        assert all(line in before for line in after) or rows[2][i].text == ""
        for line in after:
            assert len(line) < 20 or line not in seen
            seen.add(line)
        assert rows[2][i].n_chars == len(rows[2][i].text)


def test_no_near_copies_are_left(stages):
    rows, _ = stages
    sets = {i: grams(r.text, 5, r"[^\x20\x09-\x0D]+") for i, r in rows[2].items()}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert set(rows[3]) == {i for i in sets if label[i] == i}


def test_contaminated_rows_go(stages, spark, sf_dir):
    rows, _ = stages
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set().union(*(grams(r.text, 10, pattern) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))
    assert all(len(w) == 10 for w in windows)
    assert set(rows[4]) == {i for i, r in rows[3].items() if not windows & grams(r.text, 10, pattern)}


def test_pieces(stages):
    rows, _ = stages
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, r in rows[5].items():
        assert list(r.token_ids) == library.encode(rows[4][i].text or "") and r.n_tokens == len(r.token_ids)
        assert r.text == (rows[4][i].text or "").replace("▁", " ")


def test_edges(spark, sf_dir):
    rows = [(None, None, None, None, None), (None, "ohne id", "de", "s", 7), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, None, "en", "s", None), (3, "x" * 30_000, "en", "s", 30_000)]
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    for _, stage in p.STAGES[1:]:
        docs = shared.table(stage(spark, docs, sf_dir), "test-edge")
    got = docs.collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, None, None]
    none = spark.createDataFrame([], schema)
    for _, stage in p.STAGES:
        none = shared.table(stage(spark, none, sf_dir), "test-none")
    assert none.count() == 0


def test_different_texts_under_one_id(spark, sf_dir):
    same = " ".join(f"wort{k}" for k in range(60))
    rows = [(3, same), (5, same + " neu"), (5, "etwas ganz anderes\nund mehr"), (7, "erste Zeile\nzweite"), (8, "erste Zeile"), (8, "einzig"), (None, "ohne id und\nund mehr")]
    docs = spark.createDataFrame([(i, t, "de", "s", len(t)) for i, t in rows], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    left = p.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted((str(i), t) for i, t in rows if t != same + " neu")
    cut = {(r.doc_id, r.text) for r in p.drop_lines(spark, docs, sf_dir).collect()}
    assert {(5, "etwas ganz anderes"), (7, "erste Zeile\nzweite"), (8, ""), (8, "einzig"), (None, "ohne id und\nund mehr")} <= cut
    path = shared.scratch(spark, "sf")
    spark.createDataFrame([(1, "gut so"), (None, "gut so\ngut so")], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in line_dedup.op1_line_dedup(spark, path).collect()}
    assert got == {None: "1", 1: "0"}
