"""Fill-in-middle transformation: texts cut in three by code points, their parts put in another order.

The cuts are drawn from a hash of the id, so every run and every partitioning
gives the same ones.  They are converted between code points and bytes with a
sparse exception index (codepoints.Exceptions) of a batch's multibyte characters;
nothing is decoded, and no character positions of plain ASCII are kept.

Defined results: null texts are empty; empty texts, texts with one of the three
marks and rows without id stay plain; repeated ids get equal draws, so equal rows
get equal results; an empty table gives an empty result.  Other columns than the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import shared, textbytes
from plinth.llm.codepoints import Exceptions

# The marks before the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def _marked(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds a mark."""
    at = np.flatnonzero(raw[:-2] == ord("<")) if len(raw) > 2 else np.zeros(0, np.int64)
    at = at[(raw[at + 2] == ord(">")) & np.isin(raw[at + 1], np.frombuffer(b"PSM", np.uint8))]
    row = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def _cut(plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in shared.sliced(batch, 1):
                raw, offsets = textbytes.buffers(piece.column(1))
                drawn = [piece.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in range(2, 6)]
                index = Exceptions(raw)
                first = index.chars(offsets)
                n = np.diff(first)
                plain = (n == 0) | _marked(raw, offsets) | (drawn[2] % 100 >= plain_from) | piece.column(2).is_null().to_numpy(zero_copy_only=False)
                form = np.where(plain, "plain", np.where(drawn[3] % 100 < spm_below, "spm", "psm"))
                one, two = drawn[0] % (n + 1), drawn[1] % (n + 1)
                low, high = np.minimum(one, two), np.maximum(one, two)
                a, b = index.bytes(first[:-1] + low), index.bytes(first[:-1] + high)
                data, texts = memoryview(raw), []
                for kind, start, p, m, end in zip(form.tolist(), offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True):
                    prefix, middle, suffix = data[start:p], data[p:m], data[m:end]
                    if kind == "plain":
                        texts.append(bytes(data[start:end]))
                    elif kind == "psm":
                        texts.append(b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)))
                    else:
                        texts.append(b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)))
                some = lambda values: pa.array(values, pa.int64(), mask=plain)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), some(low), some(high - low), some(a - offsets[:-1]), some(b - a), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output): a row for each row of `docs`.

    The first four groups of eight digits of sha256(seed:id), as unsigned integers
    h1 to h4, give the cuts (h1 and h2 modulo n + 1, for n code points), whether
    the row stays plain (h3 % 100 >= plain_from) and its form (spm where
    h4 % 100 < spm_below, else psm).
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")), 256)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), digest.alias("digest"))
    drawn = [F.conv(F.substring("digest", 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]
    kind = dict(docs.select(F.col(id_column).alias("id")).dtypes)["id"]
    schema = f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, prefix_bytes bigint, middle_bytes bigint, output string"
    return rows.select("id", "text", *drawn).mapInArrow(_cut(plain_from, spm_below), schema)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns, form and output, become the text and its parts' code points."""
    for batch in batches:
        for piece in shared.sliced(batch, batch.num_columns - 1):
            forms = piece.column(piece.num_columns - 2).to_pylist()
            raw, offsets = textbytes.buffers(piece.column(piece.num_columns - 1))
            data, texts, cuts = raw.tobytes(), [], []
            for form, start, end in zip(forms, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if form not in ("psm", "spm"):
                    texts.append(data[start:end])
                    cuts.append((start, start, start, start))
                    continue
                second = data.index(SUFFIX if form == "psm" else PREFIX, start + 3, end)
                third = data.index(MIDDLE, second + 3, end)
                parts = (start + 3, second), (second + 3, third)
                prefix, suffix = parts if form == "psm" else parts[::-1]
                texts.append(b"".join((data[slice(*prefix)], data[third + 3 : end], data[slice(*suffix)])))
                cuts.append((*prefix, third + 3, end))
            chars = Exceptions(raw).chars(np.array(cuts, np.int64).reshape(-1, 4))
            plain = np.array([f not in ("psm", "spm") for f in forms], bool)
            columns = [piece.column(k) for k in range(piece.num_columns - 2)]
            columns += [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 3] - chars[:, 2], pa.int64(), mask=plain)]
            yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names[:-2], "restored", "restored_prefix_chars", "restored_middle_chars"])


def restore(rows: DataFrame, *, keep: tuple[str, ...] = ("id",), form_column: str = "form", output_column: str = "output") -> DataFrame:
    """(keep, restored, restored_prefix_chars, restored_middle_chars): the texts rebuilt from outputs and forms alone."""
    held = rows.select(*keep, F.col(form_column).alias("__form"), F.col(output_column).alias("__output"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in held.dtypes[:-2])
    return held.mapInArrow(_join, f"{kinds}, restored string, restored_prefix_chars bigint, restored_middle_chars bigint")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every document.

    Null texts are empty; empty texts, texts that hold a mark and rows without id
    stay plain, with null counts; equal rows give equal results.
    """
    made = fill_in_middle(shared.load(spark, sf_dir, "documents")).withColumn("output_sha256", F.sha2("output", 256))
    kept = ("id", "n", "form", "prefix_chars", "middle_chars", "output_sha256")
    back = restore(made, keep=kept)
    return back.select(F.col("id").alias("doc_id"), *kept[1:], F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""
