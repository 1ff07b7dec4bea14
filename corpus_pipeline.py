"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns the columns of documents; the last one adds the ids.

1. quality: documents whose predicted quality is 0 go.
2. lines: lines that repeat an earlier line, or nearly so, go from the texts.
3. near_copies: of documents linked at a similarity of 0.8 of their sets of five
   words, the one with the smallest id stays.
4. decontaminate: documents with a passage of the benchmark go.
5. pieces: texts become SentencePiece ids, and are what these decode to.

n_chars is the text's length whenever a stage changes texts.  Rows with null texts
pass the stages as empty ones do; rows without id are never copies of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import decontaminate, jaccard, line_dedup, quality, sentencepiece_codec, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted label is 1.  Repeated rows get equal scores; an empty text's score is the model's constant."""
    weights = quality.train(quality.training_rows(docs, shared.load(spark, sf_dir, "labels")))
    scored = quality.score(docs.select(COLUMNS), weights, keep=("text", "lang", "source", "n_chars"))
    return scored.filter("predicted = 1").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without repeated lines; a text may become empty."""
    cut = line_dedup.drop_repeated_lines(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, one with its smallest id; of equal texts with one id one stays; rows without id stay.

    Rows are told apart by a hash of id and text, so different texts with one id are different documents.
    """
    docs = docs.select(COLUMNS)
    keyed = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = jaccard.jaccard_components(keyed.select("key", "text"), id_column="key", n=5, num=80, den=100)
    named = found.select("key", "component_id").join(keyed.select("key", "doc_id").distinct(), "key")
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "key"))["key"].alias("key")).select("key")
    one = keyed.join(kept, "key", "left_semi").dropDuplicates(["key"])
    return one.select(COLUMNS).unionByName(docs.filter("doc_id is null")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of ten words of the benchmark."""
    docs = docs.select(COLUMNS)
    index = decontaminate.Index(docs, shared.load(spark, sf_dir, "benchmark"))
    found = decontaminate.find(docs, index, keep=("text", "lang", "source", "n_chars"))
    return found.filter(F.size("spans") == 0).select(COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with the decoded text, and token_ids and n_tokens."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode_and_decode(docs.select(COLUMNS), model)
    return coded.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pieces", to_pieces),
]

#: Training, edit distances of characters and piece ids aren't within SQL's reach: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
