"""Queries over the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, binary_output, decontaminate, infill, language, lines, neardup, permutation, quality, scoring, secrets, sentencepieces, suffixes
from marlstone.llm.oracles import LLM_ORACLES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": scoring.query,
    "op2_minhash_neardup": neardup.query,
    "op3_decontamination": decontaminate.query,
    "op4_suffix_dedup": suffixes.query,
    "op5_line_dedup": lines.query,
    "op6_language_id": language.query,
    "op7_secret_scan": secrets.query,
    "op8_quality": quality.query,
    "op9_sentencepiece": sentencepieces.query,
    "op10_binary_output": binary_output.query,
    "op11_permutation_index": permutation.query,
    "op12_cross_tokenizer": alignment.query,
    "op13_fill_in_middle": infill.query,
}


def lm_base_scores(spark: SparkSession, sf: str) -> DataFrame:
    """What op1 returns beside the model's score."""
    d = scoring.query(spark, sf)
    return d.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_base(spark: SparkSession, sf: str) -> DataFrame:
    """op8's statistics and base rules, without the estimate's verdict."""
    d = quality.base_statistics(spark.read.parquet(f"{sf}/documents.parquet"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


#: More queries over the same operators.
LLM_QUERIES |= {"pages_language_id": language.pages_query, "lm_base_scores": lm_base_scores, "quality_base": quality_base}
