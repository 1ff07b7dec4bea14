"""Token files, SentencePiece, WARC archives and embeddings against plain versions."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plinth.llm import components, embedding_dedup, sentencepiece_codec, shared, token_output, warc

TEXTS = [
    "Ein Satz, mit Komma.\n\nUnd  zwei   Leerzeichen.", None, "", " ", "don't we'll I'M x'sy", "é è   ü 日本語 🎉🎉", "a|b <|endoftext|> c<|endoftext|> d", "tabs\tand \t spaces \n x", "wort " * 4000, "x" * 9000,
    "▁ mark▁ed", "12345 678.90 $$$ %%%the*** the### the", "Ein Satz, mit Komma.\n\nUnd  zwei   Leerzeichen.",
]


def docs(spark):
    rows = [(i * 7 % 11, t, "en", i) for i, t in enumerate(TEXTS)] + [(None, "ohne id", "de", 99)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, start int").repartition(3)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, encoding):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = shared.scratch(spark, "t")
    token_output.write_tokens(docs(spark), path, public_tokenizers.path("byte_bpe_50k.json"), encoding=encoding, page_rows=2)
    got = token_output.token_digests(token_output.read_tokens(spark, path)).collect()
    rows = sorted(((r.doc_id, r.text) for r in docs(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.doc_id for r in token_output.read_tokens(spark, path, (3, 5)).collect()} == {3, 4, 5}


def test_sentencepiece(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    coded = sentencepiece_codec.encode(docs(spark), model)
    assert coded.columns == [*docs(spark).columns, "token_ids"]
    back = sentencepiece_codec.decode(coded, model).collect()
    assert len(back) == len(TEXTS) + 1
    for r in back:
        assert list(r.token_ids) == library.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_sentencepiece_on_corpus(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = sentencepiece_codec.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model).collect()
    assert all(list(r.token_ids) == library.encode(r.text or "") for r in rows)


def test_sentencepiece_query_is_the_library(spark, sf_dir):
    """Digests in one pass: ids of the library over every document, nulls, empties and repeats with them."""
    import zlib

    import public_tokenizers

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "a \u2581b"), (-2, "a \u2581b"), (-3, "x" * 5000)], "doc_id bigint, text string")
    rows = table.union(odd)
    got = sorted(map(tuple, sentencepiece_codec.digests(rows, public_tokenizers.path("piece_bpe_32k.model")).collect()), key=str)
    want = []
    for r in rows.collect():
        ids = library.encode(r.text or "")
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), library.decode(ids) == (r.text or "").replace("\u2581", " ")))
    assert got == sorted(want, key=str)
    both = sentencepiece_codec.encode_and_decode(odd, public_tokenizers.path("piece_bpe_32k.model"))
    assert both.columns == ["doc_id", "text", "token_ids", "decoded"] and [r.decoded for r in both.collect()] == ["", "", "a  b", "a  b", "x" * 5000]


def test_empty_tables(spark):
    model, none = public_tokenizers.path("piece_bpe_32k.model"), docs(spark).limit(0)
    assert sentencepiece_codec.decode(sentencepiece_codec.encode(none, model), model).count() == 0
    path = shared.scratch(spark, "t")
    token_output.write_tokens(none, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_output.read_tokens(spark, path).count() == 0


def pages(spark):
    big = "<p>" + "gleich " * 40 + "</p>\r\n\r\nnoch"
    rows = [(5, "http://B.example.com/x?q=1#f", big), (2, "https://www.example.com:443/a b", big), (9, None, big), (3, "kein url", "kurz"), (4, "http://b.example.com/x?q=1", "kurz"), (6, "http://c.org", None), (7, "http://c.org/\nX-Bad: 1", ""), (None, "http://d.org", big), (2, "http://e.org", big), (8, "http://b.example.com/é", "é" * 99), (10, "http://z.net", "é" * 99)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string").repartition(3)


def test_warc(spark):
    path = shared.scratch(spark, "w")
    warc.write_warc(pages(spark), path, records_per_archive=2)
    merged = warc.merge_captures(warc.read_captures(spark, path))
    got = merged.collect()
    source = pages(spark).collect()
    assert len(got) == len(source)
    first = {}
    for r in source:
        data = (r.html or "").encode()
        if r.page_id is not None and len(data) >= 100:
            first[data] = min(first.get(data, r.page_id), r.page_id)
    want = []
    for r in source:
        data = (r.html or "").encode()
        other = first.get(data) if r.page_id is not None and r.page_id > first.get(data, 2**62) else None
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if other is not None else "response", other))
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    keys = [(r.url_key, r.captured, -1 if r.id is None else r.id) for r in got]
    assert keys == sorted(keys) and "com,example,b)/x?q=1" in {k[0] for k in keys}


def test_loser_tree():
    rng = np.random.default_rng(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((int(x),) for x in rng.integers(0, 50, rng.integers(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    near = base[:10] + rng.normal(size=(10, 16)) * 0.1
    group = base[0] + rng.normal(size=(60, 16)) * 0.05
    all_ = np.concatenate([base, near, group]).astype("f4")
    rows = [(i + 3, [float(x) for x in v]) for i, v in enumerate(all_)]
    rows += [(1, rows[0][1]), (2, rows[0][1]), (900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (None, rows[0][1]), (2, rows[0][1]), (907, [float("inf")] + [0.0] * 15), (908, [2 * x for x in rows[0][1]])]
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, id int").repartition(3)


@pytest.mark.parametrize("options", [{}, {"block": 20, "shards": 2, "most_in_shard": 30}])
def test_embeddings(spark, options):
    rows = [(r.vec_id, r.embedding) for r in vectors(spark).collect()]
    good = [i is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    n, label = [0] * len(rows), [i for i, _ in rows]
    link = {(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.9}
    for a, _ in link:
        n[a] += 1
    for _ in rows:
        for a, b in link:
            label[a] = label[b] = min(label[a], label[b])
    want = sorted(((rows[k][0], n[k], label[k]) for k in range(len(rows))), key=str)
    got = embedding_dedup.cosine_components(vectors(spark), **options).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_embedding_recall(spark, sf_dir):
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(f"{sf_dir}/embeddings.parquet")["embedding"].to_pylist())
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    world = embedding_dedup.SmallWorld(x, np.arange(len(x)))
    ids, _ = world.search(x, 64)
    true = np.argsort(-(x @ x.T), 1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) >= 0.9


def test_audit_counts_no_row_as_its_own_link():
    rng = np.random.default_rng(11)
    base = rng.normal(size=(2000, 32))
    base[1000:1026] = base[:26] + rng.normal(size=(26, 32)) * 0.05
    x = (base / np.linalg.norm(base, axis=1, keepdims=True)).astype("f4")
    world = embedding_dedup.SmallWorld(x, np.arange(len(x)))
    full = world.search

    def blind(q, beam):  # a search that finds a row itself but loses the links of the copies
        ids, sims = full(q, beam)
        gone = (sims < 0.9999) & (sims >= 0.9)
        return np.where(gone, -1, ids), np.where(gone, -2, sims)

    world.search = blind
    beam = embedding_dedup.audited_beam(world, 0.9, 0.98)
    true = x @ x.T >= 0.9
    assert [sorted(found.tolist()) for found in world.within(x, 0.9, beam)] == [np.flatnonzero(r).tolist() for r in true]


def test_rows_without_a_path_are_found():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1500, 16))
    x[700:740] = x[:40] + rng.normal(size=(40, 16)) * 0.02
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    world = embedding_dedup.SmallWorld(x, np.arange(len(x)))
    cut = np.isin(np.arange(len(x)), range(700, 740))
    world.levels[0] = np.where(np.isin(world.levels[0], np.flatnonzero(cut)), -1, world.levels[0])
    world.reach()
    assert set(np.flatnonzero(cut)) <= set(world.loose) | {world.entry}
    found = world.within(x[:40], 0.9, 32)
    assert all(700 + k in f for k, f in enumerate(found))


def test_links_are_counted_for_both_sides(spark):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(1, 8)) + rng.normal(size=(90, 8)) * 0.25
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(base)], "vec_id bigint, embedding array<float>")
    x = np.array([r.embedding for r in rows.collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    for block in (4096, 20):
        got = {r.vec_id: r.n_links for r in embedding_dedup.cosine_components(rows, block=block).collect()}
        assert [got[i] for i in range(90)] == want.tolist()


def test_no_vectors(spark):
    assert embedding_dedup.cosine_components(vectors(spark).limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55), (70, 70), (5, 1), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_embedding_graph_memory():
    """Building a graph holds the neighbours' vectors of a few hundred rows, not those of a whole batch's (77 MB here before)."""
    x = np.random.default_rng(3).normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    embedding_dedup.SmallWorld(x, np.arange(len(x)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
