"""Personal data, fill-in-middle cuts and hard negatives against plain versions on small tables."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import fill_middle, hard_negatives, personal_data, shared
from plinth.llm.codepoints import Exceptions

SCHEMA = "doc_id bigint, text string, id string, n int, form string, spans string, output string"


def frame(spark, rows, parts=3):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "o") for i, t in rows], SCHEMA).repartition(parts)


def test_exceptions():
    text = "aé€😀b" * 7 + "plain" + "ü"
    raw = np.frombuffer(text.encode(), np.uint8)
    index = Exceptions(raw)
    cuts = np.arange(len(text) + 1)
    want = np.array([len(text[:k].encode()) for k in cuts])
    assert (index.bytes(cuts) == want).all() and (index.chars(want) == cuts).all()
    assert "".join(map(chr, index.code_points(raw))) == "".join(c for c in text if c > "\x7f")
    assert Exceptions(raw[:0]).bytes(np.array([0])) == 0


# --- fill in middle ------------------------------------------------------------------------

TEXTS = [None, "", "x", "ab <S> c", "<P", "é", "naïve 😀 text with ünïcode" * 20, "plain ascii " * 50, "日本語" * 4000, "<M>", "a<", "nul\x00byte " * 9, "same", "same"]


def plain_cut(i, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    if i is None or not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, t)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return (i, n, "spm", p, q - p, f"<S>{t[q:]}<P>{t[:p]}<M>{t[p:q]}")
    return (i, n, "psm", p, q - p, f"<P>{t[:p]}<S>{t[q:]}<M>{t[p:q]}")


def test_fill_in_middle(spark):
    rows = [(i, t) for i in range(40) for t in (TEXTS[i % len(TEXTS)], TEXTS[(i + 5) % len(TEXTS)])] + [(None, "no id"), (7, "twice"), (7, "twice")]
    made = fill_middle.fill_in_middle(frame(spark, rows))
    got = sorted(((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=str)
    assert got == sorted((plain_cut(i, t) for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fill_middle.restore(made, keep=("id", "prefix_chars", "middle_chars")).collect()
    assert all((r.prefix_chars, r.middle_chars) == (r.restored_prefix_chars, r.restored_middle_chars) for r in back)
    assert sorted(((r.id, r.restored) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    made = made.filter("form <> 'plain'").select("prefix_chars", "prefix_bytes", "output", "form", "middle_bytes").collect()
    assert all(len(r.output[3 : 3 + r.prefix_chars].encode()) == r.prefix_bytes for r in made if r.form == "psm")


def test_fill_in_middle_empty(spark):
    made = fill_middle.fill_in_middle(frame(spark, []))
    assert fill_middle.restore(made).collect() == []


# --- personal data ---------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            twice = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if fits[kind]:
                out.append((kind, m.start(), m.end()))
    return out


CARD = "4539148803436467"
BASE = [
    "mail a.b@c.de, x@y@z.org and @no.com no@com a@b.c@d.e; é.q@mail.fr, a@b..c a@-.-", "1.2.3.4.5.6.7.8.9 256.1.1.1 1.2.3 00001.2.3.255 ipv 10.0.0.1. 1.2.3.4é5.6.7.8 999.1.2.3.4.5.6.7",
    f"{CARD} {CARD[:4]}-{CARD[4:8]}-{CARD[8:12]} {CARD[12:]} {CARD}1 {CARD[:8]}  {CARD[8:]} 1234567890123456", f"+1 (743) 555-3824 +49-30.1234 +12345678+12345678 +1 2 +{CARD}9 ++1234567890 +1.2.3.4.5.6.7.8",
    None, "", "é" * 50 + "a@b.cd" + "日本" * 9 + "+1 743 555 3824", "9" * 5000, "@" * 3000, "1 " * 3000, "a." * 2000 + "@b.c", "+1" * 2000, "nul\x00a@b.cd\x00", "x@" + "y." * 500 + "z",
]

#: Text, kind, the source text of the span that undoing adds, its value.
HIDDEN = [
    ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com", "jane.doe@example.com"),
    ("jane(at)example.org", "email", "jane(at)example.org", "jane@example.org"),
    ("reach Jane.Doe AT Example DOT co DOT uk!", "email", "Jane.Doe AT Example DOT co DOT uk", "jane.doe@example.co.uk"),
    ("jane dot doe at example dot com", "email", "jane dot doe at example dot com", "jane.doe@example.com"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ end", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "jane@example.com"),
    ("write jаne@exаmple.com", "email", "jаne@exаmple.com", "jane@example.com"),
    ("juan arroba ejemplo punto es", "email", "juan arroba ejemplo punto es", "juan@ejemplo.es"),
    ("jane @ example.com", "email", "jane @ example.com", "jane@example.com"),
    ("jane​@exam­ple.com", "email", "jane​@exam­ple.com", "jane@example.com"),
    ("host 192 dot 168 dot 0 dot 12 up", "ip", "192 dot 168 dot 0 dot 12", "192.168.0.12"),
    ("host 192[.]168[.]0[.]12 up", "ip", "192[.]168[.]0[.]12", "192.168.0.12"),
    ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
    ("call plus one seven four three five five five three eight two four today", "phone", "plus one seven four three five five five three eight two four", "+17435553824"),
    ("ruf +49 eins sieben sechs, 1234567 an", "phone", "+49 eins sieben sechs", None),
    ("+٤٩ ١٧٦ ١٢٣٤٥٦٧", "phone", "+٤٩ ١٧٦ ١٢٣٤٥٦٧", "+49 176 1234567"),
    ("+1 743 555‑3824", "phone", "+1 743 555‑3824", "+1 743 555-3824"),
    ("card four five three nine one four eight eight zero three four three six four six seven.", "card", "four five three nine one four eight eight zero three four three six four six seven", CARD),
    ("card 4539 l488 O343 6467", "card", "4539 l488 O343 6467", "4539 1488 0343 6467"),
    ("card 4539 double one", "card", None, None),
    ("jane . doe @ example . com", "email", "jane . doe @ example . com", "jane.doe@example.com"),
    ("jane{at}example.com", "email", "jane{at}example.com", "jane@example.com"),
    ("jane@example [dot] com", "email", "jane@example [dot] com", "jane@example.com"),
    ("host 192 . 168 . 0 . 12 up", "ip", "192 . 168 . 0 . 12", "192.168.0.12"),
    ("host 192.168.O.12 up", "ip", "192.168.O.12", "192.168.0.12"),
    ("call +1 (seven four three) five five five-three eight two four", "phone", "+1 (seven four three) five five five-three eight two four", "+1 (7435553824"),
    ("④⑤③⑨ 1488 0343 6467", "card", "④⑤③⑨ 1488 0343 6467", "4539 1488 0343 6467"),
    ("４５３９１４８８０３４３６４６７", "card", "４５３９１４８８０３４３６４６７", CARD),
]

CLEAN = [
    "We met at noon. The dot on the map is at one point, two miles away.", "available at example.com and look at section one dot two", "drei zwei eins los! un deux trois soleil", "prix : 12 345 678 € — 2019–2020",
    "Привет, мир! Адрес: дом 5", "3 @ 4 or 5 @ 6.50", "see http://www.example.com/a?b=c#d", "0l1 10l 20O0", "1. 2. 3. 4. end", "a . b . c", "look at item 1.5 (two) three, four",
]


def test_plain_identifiers(spark):
    rows = [(i, t) for i, t in enumerate([*BASE, *CLEAN, *(h[0] for h in HIDDEN)])] + [(None, BASE[0]), (3, BASE[3]), (3, BASE[3])]
    got = sorted(((r.id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in personal_data.find(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((i, plain_spans(t)) for i, t in rows), key=str)


def test_plain_identifiers_at_random():
    rng = np.random.default_rng(5)
    alphabet = list("0123456789012345678901.+-() @ab.%é\n")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 90))) for _ in range(800)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    index = Exceptions(raw)
    found = {}
    for r, kind, a, b in personal_data.detect(raw, offsets):
        a, b = (int(x - index.chars(offsets[r : r + 1])[0]) for x in index.chars(np.array([a, b])))
        found.setdefault(r, []).append((personal_data.KINDS[kind], a, b))
    assert [found.get(k, []) for k in range(len(texts))] == [plain_spans(t) for t in texts]
    assert sum(map(len, found.values())) > 50


@pytest.mark.parametrize("text, kind, source, value", HIDDEN)
def test_disguises(text, kind, source, value):
    found = [(personal_data.KINDS[k], text[a:b], v) for k, a, b, v in personal_data.disguised(text)]
    if value is None:
        assert found == [] or source and all(s.startswith(source) for _, s, _ in found)
    else:
        assert found == [(kind, source, value)]


def test_clean_texts_stay_clean(spark):
    rows = list(enumerate(CLEAN))
    assert all(r.spans == [] for r in personal_data.find(frame(spark, rows)).collect())


def test_disguises_in_tables(spark):
    """Every disguise is triggered in whole texts, between long plain stretches; masked texts hold none of them."""
    pad = "Lorem ipsum à la carte. " * 3000
    rows = [(k, f"{pad}{h[0]} {pad}") for k, h in enumerate(HIDDEN)]
    got = {r.id: r for r in personal_data.find(frame(spark, rows), mask=True).collect()}
    for k, (_, kind, source, value) in enumerate(HIDDEN):
        if value:
            at = rows[k][1].index(source)
            assert [(s.kind, s.start, s.end) for s in got[k].spans if not s.base] == [(kind, at, at + len(source))]
            assert source not in got[k].masked and f"[{kind.upper()}]" in got[k].masked
            assert got[k].masked.replace(f"[{kind.upper()}]", "") in rows[k][1].replace(source, "")


def test_personal_data_query(spark, sf_dir):
    """The query against the plain patterns on whole tables."""
    from plinth.llm.registry import QUERIES

    texts = {r.doc_id: r.text for r in shared.load(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    got = QUERIES["op11_personal_data"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = plain_spans(texts[r.doc_id])
        said = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in spans) for k in personal_data.KINDS]
        every = [s for s in r.spans.split(",") if s]
        assert set(said) <= set(every) and len(every) == len(said) + r.n_disguised
    assert personal_data.find(frame(spark, [])).collect() == []


# --- hard negatives -------------------------------------------------------------------------------


def plain_mine(rows, anchor):
    """rows: {id: (label, integer vector)}."""
    out = []
    for a in sorted(i for i in rows if anchor(i)):
        label, q = rows[a]
        score = {i: sum(x * y for x, y in zip(q, v, strict=True)) for i, (_, v) in rows.items() if i != a and len(v) == len(q)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:5]:
            fits = [i for i in order if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:3])]
    return out


def vectors(seed, n, size, copies=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, size))
    v = (middle[rng.integers(0, 5, n)] + rng.normal(size=(n, size)) * 0.6) / math.sqrt(size)
    v[:copies] = v[0]
    return v.astype(np.float32)


@pytest.mark.parametrize("seed, n, size, copies", [(1, 300, 8, 0), (2, 900, 4, 300), (3, 120, 1, 40), (4, 700, 16, 10)])
def test_hard_negatives(spark, monkeypatch, seed, n, size, copies):
    monkeypatch.setattr(hard_negatives, "PAGE", 16)
    monkeypatch.setattr(hard_negatives, "SLAB", 150)
    v = vectors(seed, n, size, copies)
    labels = np.random.default_rng(seed).integers(0, 4, n)
    rows = [(i, v[i].tolist(), int(labels[i]), "x", 1) for i in range(n)]
    rows += [(n, None, 1, "x", 1), (n + 1, [float("nan")] * size, 1, "x", 1), (n + 2, v[0].tolist(), None, "x", 1), (None, v[0].tolist(), 1, "x", 1), (n + 3, [float("inf")] * size, 2, "x", 1), (n + 4, [], 2, "x", 1)]
    rows += [(n + 10, [0.5] * (size + 1), 1, "x", 1), (n + 11, [0.75] * (size + 1), 1, "x", 1), (n + 12, [0.6] * (size + 1), 2, "x", 1), (5, v[5].tolist(), int(labels[5]), "x", 1), (n + 13, [3e38] * size, 1, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, slab string, page int").repartition(5)
    integer = hard_negatives.integer_vectors(df)
    got = sorted(map(tuple, hard_negatives.mine(integer, (F.col("id") % 10 == 0) | (F.col("id") > n)).collect()))
    held = {i: (lab, [math.floor(256 * x) for x in vec]) for i, vec, lab, _, _ in rows if i is not None and vec is not None and lab is not None and all(map(math.isfinite, vec)) and max(vec, default=0) < 1e30}
    want = sorted(plain_mine(held, lambda i: i % 10 == 0 or i > n))
    assert got == want and len(got) > 30


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(hard_negatives.integer_vectors(df), F.col("id") % 50 == 0).collect() == []


def test_trees_prune():
    """Ties at the k-th score are kept, boxes strictly below aren't opened; sums beyond doubles' whole numbers stay exact."""
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.integers(-40, 40, (400, 6)) + c for c in ([900] * 6, [-900] * 6, [0] * 6)]).astype(np.int64)
    for scale in (1, 2**18):
        order = hard_negatives.str_order(v, 32)
        assert sorted(order.tolist()) == list(range(len(v)))
        ids, labels = order.astype(np.int64), (order % 3).astype(np.int64)
        cuts = range(0, len(v), 32)
        tree = hard_negatives.Tree([(ids[k : k + 32], labels[k : k + 32], v[order[k : k + 32]] * scale) for k in cuts])
        opened = []
        tree.pages = type("Pages", (list,), {"__getitem__": lambda s, k: opened.append(k) or list.__getitem__(s, k)})(tree.pages)
        q = v[7] * scale
        score = [int(sum(int(a) * int(b) for a, b in zip(q, x * scale, strict=True))) for x in v]
        windows = np.array([[-(2**62), 2**62], [0, max(score) // 2]], np.int64)
        for same in (True, False):
            found = tree.search(7, 1, q, same, windows, 4)
            for (low, high), got in zip(windows.tolist(), found, strict=True):
                fits = sorted((-s, i) for i, s in enumerate(score) if (i % 3 == 1) == same and i != 7 and low <= s <= high)[:4]
                assert got == [(-s, i) for s, i in fits]
        opened.clear()
        tree.search(7, 1, q, True, windows[:1], 4)
        assert len(set(opened)) < len(cuts) / 2
