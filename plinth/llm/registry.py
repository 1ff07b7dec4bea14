"""Queries of this subpackage and their DuckDB SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import decontaminate, embedding_dedup, fill_middle, hard_negatives, jaccard, line_dedup, personal_data, pitman_yor, quality, sentencepiece_codec, suffix_dedup, token_output, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_output": token_output.op3_token_output,
    "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
    "op5_ngram_jaccard": jaccard.op5_ngram_jaccard,
    "op6_language_model": pitman_yor.op6_language_model,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_warc": warc.op9_warc,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_personal_data": personal_data.op11_personal_data,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": embedding_dedup.OP4_SQL,
    "op5_ngram_jaccard": jaccard.OP5_SQL,
    "op7_decontamination": decontaminate.OP7_SQL,
    "op9_warc": warc.OP9_SQL,
    "op12_fill_in_middle": fill_middle.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
