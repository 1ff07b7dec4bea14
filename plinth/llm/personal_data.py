"""Personal data in whole texts: e-mail and IP addresses, payment cards, phone numbers, disguised ones too.

Plain identifiers are found on the bytes of whole batches: their digits, dots and
signs are ASCII, so runs and chains of positions settle what the patterns match.
Byte spans become code points by the sparse index of multibyte characters.

Disguises are undone by transducers that keep offsets.  A View is a normalised text
whose every character knows the source span it stands for:

1. characters: look-alikes, full-width and mathematical forms, digits of any
   script, spaces and dashes of any kind; invisible format characters vanish;
2. three or more spelled digits in a row, in four languages, with spelled dots
   between and a spelled plus before;
3. letters that stand for digits between digits, bracketed or spelled dots
   between digits;
4. e-mail addresses with a bracketed, spelled or spaced at, or such dots.

What is found in the view is mapped back to the source; it counts if something
in it was undone and no plain span of its kind holds it already.  Views are made
only of texts that hold a trigger, searched for in whole texts by linear-time
patterns.

Defined results: null and empty texts have no spans; equal texts have equal
spans, whatever the ids; rows without id are searched too; an empty table gives
an empty result.  Other columns than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared, textbytes
from plinth.llm.codepoints import Exceptions

KINDS = ("email", "ip", "card", "phone")

# --- fixed values ----------------------------------------------------------------------

#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "ѵ": "v", "ӏ": "l",
    "А": "a", "В": "b", "Е": "e", "К": "k", "М": "m", "Н": "h", "О": "o", "Р": "p", "С": "c", "Т": "t", "У": "y", "Х": "x", "І": "i", "Ј": "j", "Ѕ": "s", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ϲ": "c", "ϳ": "j",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "օ": "o", "ѡ": "w", "。": ".", "・": ".", "∙": ".", "﹢": "+", "⁺": "+", "∕": "/",
}

#: Spelled digits of English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "point", "punto")

# --- plain identifiers ---------------------------------------------------------------------


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_LOCAL, _DIGIT = _class(_ALNUM + b"._%+-"), _class(b"0123456789")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: bytes) -> bool:
    """Whether the digits pass the check of payment cards."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def detect(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, number of the kind, start, end) in bytes of the buffer, by row, kind and start; leftmost, not overlapping within a kind."""
    data, out = raw.tobytes(), []
    at = np.flatnonzero(_DIGIT[raw])
    row = np.searchsorted(offsets, at, "right") - 1
    gap, same = np.diff(at), np.diff(row) == 0

    # cards: digits that follow one another with at most one space or hyphen between
    linked = same & ((gap == 1) | ((gap == 2) & np.isin(raw[np.minimum(at[:-1] + 1, len(raw) - 1)], (0x20, 0x2D))))
    first = np.flatnonzero(np.concatenate([[len(at) > 0], ~linked]) if len(at) else np.zeros(0, bool))
    size = np.diff(np.append(first, len(at)))
    for k in np.flatnonzero((size >= 16) & (size <= 19)).tolist():
        digits = at[first[k] : first[k] + size[k]]
        if luhn(raw[digits].tobytes()):
            out.append((int(row[first[k]]), 2, int(digits[0]), int(digits[-1]) + 1))

    # addresses: four runs of digits with dots between; a chain of runs is taken four by four
    joined = same & (gap == 1)
    head = np.flatnonzero(np.concatenate([[len(at) > 0], ~joined]) if len(at) else np.zeros(0, bool))
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    start, end = at[head], at[tail] + 1
    dotted = (start[1:] == end[:-1] + 1) & (raw[np.minimum(end[:-1], len(raw) - 1)] == 0x2E) & (row[head[1:]] == row[head[:-1]]) if len(head) else np.zeros(0, bool)
    chain = np.flatnonzero(np.concatenate([[True], ~dotted])) if len(head) else head
    for k, n in zip(chain.tolist(), np.diff(np.append(chain, len(head))).tolist(), strict=True):
        for i in range(k, k + n - 3, 4):
            if all(int(data[start[i + j] : end[i + j]].lstrip(b"0")[:4] or b"0") <= 255 for j in range(4)):
                out.append((int(row[head[i]]), 1, int(start[i]), int(end[i + 3])))

    for p in np.flatnonzero(raw == 0x2B).tolist():
        r = int(np.searchsorted(offsets, p, "right")) - 1
        if (m := _PHONE.match(data, p, int(offsets[r + 1]))) and 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            out.append((r, 3, p, m.end()))

    last = 0  # the end of the last address or sign: none goes on before it
    for p in np.flatnonzero(raw == 0x40).tolist():
        r = int(np.searchsorted(offsets, p, "right")) - 1
        low = max(last, int(offsets[r]))
        bad = np.flatnonzero(~_LOCAL[raw[low:p]])
        begin, last = low + int(bad[-1]) + 1 if len(bad) else low, max(last, p + 1)
        if begin < p and (m := _DOMAIN.match(data, p + 1, int(offsets[r + 1]))):
            out.append((r, 0, begin, m.end()))
            last = m.end()
    return sorted(out)


# --- disguises ---------------------------------------------------------------------------------

_OTHER = "\xff"  # any character that stands for itself alone


def folded(c: str) -> str:
    """The ASCII character that a character stands for, "" for invisible ones, else a sign for others."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    digit = unicodedata.digit(c, None)
    plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c).lower()
    return plain if len(plain) == 1 and " " < plain < "\x7f" else _OTHER


class _Fold(dict):
    """For str.translate: characters as they come."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = (c.lower() if code else _OTHER) if code < 128 else folded(c)
        return out


_FOLD = _Fold()
_ACCENTS = str.maketrans({c: _OTHER for c in "éüä"})


def _either(words) -> str:
    return "|".join(sorted({w.translate(_ACCENTS) for w in words}, key=lambda w: (-len(w), w)))


_WORD = rf"(?:(?:double|triple) )?(?:{_either(DIGIT_WORDS)})"
_OPEN, _SHUT = r" *+[\[({<] *+", r" *+[\])}>] *+"
_DOT = rf"(?:{_OPEN}(?:\.|{_either(DOT_WORDS)}){_SHUT}| ++(?:{_either(DOT_WORDS)}) ++| \. |\.)"
_AT = rf"(?:{_OPEN}(?:@|{_either(AT_WORDS)}){_SHUT}| ++(?:{_either(AT_WORDS)}) ++| *+@ *+)"
_SPELLED = re.compile(rf"(?<![a-z0-9\xff])(?:plus[ -])?{_WORD}(?:(?:{_DOT}|[ ,()/-]{{1,3}}){_WORD})+(?![a-z0-9\xff])")
_TOKEN = re.compile(rf"(?P<plus>plus[ -])|(?P<times>double|triple) |(?P<digit>{_either(DIGIT_WORDS)})|(?P<dot>{_DOT})")
_LETTER = re.compile(r"(?<=[0-9])[ol|i](?=[0-9])|(?<![a-z0-9\xff])[ol|](?=[0-9]{2})|(?<=[0-9]{2})[ol|](?![a-z0-9\xff])|(?<=[0-9]\.)[ol|](?=\.[0-9])")
_DIGIT_DOT = re.compile(rf"(?<=[0-9])(?:{_OPEN}(?:\.|{_either(DOT_WORDS)}){_SHUT}| ++(?:{_either(DOT_WORDS)}) ++| \. )(?=[0-9])")
_NAME = r"[a-z0-9._%+-]++"
_ADDRESS = re.compile(rf"(?<![a-z0-9._%+-])(?P<name>{_NAME}(?:{_DOT}{_NAME}){{0,15}}+)(?P<at>{_AT})(?P<host>[a-z0-9-]++(?:{_DOT}[a-z0-9-]++){{1,15}}+)")
_ANY_DOT = re.compile(_DOT)
_VALUES = {w.translate(_ACCENTS): str(v) for w, v in DIGIT_WORDS.items()}

_BLANK = r"[\s\pZ]"
_WORDS = "|".join(DIGIT_WORDS)
#: Texts that match may hold a disguise of the second to fourth kinds; linear time, letters of either case.
TRIGGER = "|".join([
    rf"[\[({{<]{_BLANK}*(?:at|@|arroba|arobase|ät|\.|dot|punkt|point|punto){_BLANK}*[\])}}>]", rf"{_BLANK}@|@{_BLANK}", rf"{_BLANK}(?:dot|punkt|point|punto){_BLANK}",
    rf"\b(?:{_WORDS})[^a-z0-9]{{1,3}}(?:(?:dot|punkt|point|punto|double|triple)[^a-z0-9]{{1,3}})?(?:{_WORDS})[^a-z0-9]", r"[0-9][ol|i][0-9]|\b[ol][0-9]{2}|\|[0-9]{2}|[0-9]{2}[ol]\b|[0-9]{2}\||[0-9]\.[ol|]\.[0-9]|[a-z0-9] \. [a-z0-9]",
])


class View:
    """A normalised text; character k stands for source characters start[k] to end[k].  touched: source positions that were changed."""

    def __init__(self, source: str):
        self.text = source.translate(_FOLD)
        kept = np.arange(len(source))
        odd = [k for k, c in enumerate(source) if c > "\x7f"] if not source.isascii() else []
        self.touched = [k for k in odd if _FOLD[ord(source[k])] != _OTHER]
        if len(self.text) != len(source):
            kept = np.delete(kept, [k for k in odd if not _FOLD[ord(source[k])]])
        self.start, self.end = kept, kept + 1

    def rewrite(self, pattern: re.Pattern, by: Callable[[re.Match], list[tuple[int, int, str]]]) -> None:
        """Replaces what `by` says of each match: (from, to, text) in order; new characters stand for all that they replace."""
        parts, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            for low, high, new in by(m):
                parts += [self.text[at:low], new]
                starts += [self.start[at:low], np.full(len(new), self.start[low])]
                ends += [self.end[at:low], np.full(len(new), self.end[high - 1])]
                self.touched.append(int(self.start[low]))
                at = high
        if parts:
            self.text = "".join([*parts, self.text[at:]])
            self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])

    def is_touched(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.touched, start)
        return k < len(self.touched) and self.touched[k] < end


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Spelled digits of a run with three or more; what is between two of them goes, but for dots."""
    if sum(t.lastgroup == "digit" for t in _TOKEN.finditer(m[0])) < 3:
        return []
    out, at, times = [], m.start(), 1
    for t in _TOKEN.finditer(m.string, m.start(), m.end()):
        if t.lastgroup == "times":
            times = 2 if t["times"] == "double" else 3
            continue
        out += [(at, t.start(), "")] if at < t.start() else []
        out.append((t.start(), t.end(), {"plus": "+", "dot": "."}.get(t.lastgroup) or _VALUES[t[0]] * times))
        at, times = t.end(), 1
    return out


def disguised(source: str) -> list[tuple[int, int, int, str]]:
    """(number of the kind, start, end, normalised value) in code points of what undoing disguises reveals, by kind and start."""
    view = View(source)
    view.rewrite(_SPELLED, _spelled)
    view.rewrite(_LETTER, lambda m: [(m.start(), m.end(), "0" if m[0] == "o" else "1")])
    view.rewrite(_DIGIT_DOT, lambda m: [(m.start(), m.end(), ".")])
    view.touched.sort()
    raw = np.frombuffer(view.text.encode("latin-1"), np.uint8)
    found = []
    for _, kind, a, b in detect(raw, np.array([0, len(raw)])):
        value = view.text[a:b]
        glued = kind == 0 and (view.text[a - 1 : a] == _OTHER or view.text[b : b + 1] == _OTHER)  # part of a word of another script
        if not glued and view.is_touched(int(view.start[a]), int(view.end[b - 1])) and (kind or _host(value.rpartition("@")[2])):
            found.append((kind, int(view.start[a]), int(view.end[b - 1]), value))
    for m in _ADDRESS.finditer(view.text):
        dots = set(_ANY_DOT.findall(m["host"]))
        said = m["at"].strip(" ") in {w.translate(_ACCENTS) for w in AT_WORDS}
        host = _ANY_DOT.sub(".", m["host"])
        if m["at"] == "@" and dots == {"."} or said and dots == {"."} or not _host(host) or host.startswith("www."):
            continue
        found.append((0, int(view.start[m.start()]), int(view.end[m.end() - 1]), f"{_ANY_DOT.sub('.', m['name'])}@{host}"))
    return sorted(set(found))


def _host(host: str) -> bool:
    last = host.rpartition(".")[2]
    return len(last) >= 2 and last.isalpha()


# --- batches ---------------------------------------------------------------------------------------


def _triggered(texts: pa.Array, index: Exceptions, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a disguise: by the pattern, or by a character that stands for another."""
    out = pc.fill_null(pc.match_substring_regex(texts, TRIGGER, ignore_case=True), False).to_numpy(zero_copy_only=False).copy()
    codes, where = np.unique(index.code_points(raw), return_inverse=True)
    kinds = [_FOLD[c] for c in codes.tolist()]
    strong = np.array([k not in (_OTHER, " ", "-") for k in kinds], bool)[where]
    weak = np.array([k in (" ", "-") for k in kinds], bool)[where]  # spaces and dashes of prose: only beside digits
    at = index.at
    size = 2 + (raw[at] >= 0xE0).astype(np.int64) + (raw[at] >= 0xF0)
    beside = _class(b"0123456789+().@")
    weak &= beside[raw[np.maximum(at - 1, 0)]] | beside[raw[np.minimum(at + size, len(raw) - 1)]] if len(raw) else weak
    out[np.searchsorted(offsets, at[strong | weak], "right") - 1] = True
    return out


def _search(mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.sliced(batch, 1, 4 << 20):
                texts = piece.column(1)
                raw, offsets = textbytes.buffers(texts)
                index = Exceptions(raw)
                first = index.chars(offsets)
                rows: dict[int, list[tuple[int, int, int, bool, str]]] = {}
                for r, kind, a, b in detect(raw, offsets):
                    start, end = (int(x) - int(first[r]) for x in index.chars(np.array([a, b])))
                    rows.setdefault(r, []).append((kind, start, end, True, raw[a:b].tobytes().decode()))
                for r in np.flatnonzero(_triggered(texts, index, raw, offsets)).tolist():
                    plain = [s[:3] for s in rows.get(r, [])]
                    for kind, start, end, value in disguised(texts[r].as_py() or ""):
                        if not any(k == kind and a <= start and end <= b for k, a, b in plain):
                            rows.setdefault(r, []).append((kind, start, end, False, value))
                flat = [s for r in range(len(texts)) for s in sorted(rows.get(r, ()))]
                ends = np.cumsum([len(rows.get(r, ())) for r in range(len(texts))])
                kind, start, end, base, value = zip(*flat, strict=True) if flat else [()] * 5
                spans = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(base, pa.bool_()), pa.array(value, pa.string())], ["kind", "start", "end", "base", "value"])
                columns = [piece.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), spans)]
                if mask:
                    columns.append(pa.array([_masked(texts[r].as_py(), rows[r]) if r in rows else texts[r].as_py() for r in range(len(texts))], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "spans", "masked"][: len(columns)])

    return run


def _masked(text: str, spans: list[tuple[int, int, int, bool, str]]) -> str:
    """The text with each stretch of spans that overlap as the name of its first kind in brackets."""
    out, at, until = [], 0, 0
    for start, end, kind in sorted((s[1], s[2], s[0]) for s in spans):
        if start >= until:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = until = max(until, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind: string, start: bigint, end: bigint, base: boolean, value: string>>"


def find(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", mask: bool = False) -> DataFrame:
    """(id, spans, and with `mask` the text without what the spans hold): a row for each row of `docs`.

    Spans are in code points, the end exclusive, by kind (as in KINDS), then start.
    base: whether the plain patterns find the span; others hold something undone.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"id {rows.dtypes[0][1]}, spans {SPANS}" + ", masked string" * mask
    return rows.mapInArrow(_search(mask), schema)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised for every document.

    The four counts and the digest are of the plain patterns' spans, n_disguised
    counts those that the method adds, and spans lists both.  Null and empty texts
    have none.
    """
    found = find(shared.load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_disguised")
    return found.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), added)
