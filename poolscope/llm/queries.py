"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm import exact_dedup, line_dedup, mixing, spelling
from poolscope.llm.alignment import align_tokens
from poolscope.llm.language_model import log_likelihoods
from poolscope.llm.ngram_join import near_copies
from poolscope.llm.packing import pack
from poolscope.llm.quality import quality_scores
from poolscope.llm.rules import apply_rules
from poolscope.llm.search import search
from poolscope.llm.token_counts import token_counts
from poolscope.llm.toxicity import toxicity_scores


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    asked = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, asked)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_likelihoods(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_documents(spark, sf_dir))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(_documents(spark, sf_dir), _labels(spark, sf_dir))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_documents(spark, sf_dir))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_line_dedup, op2_mix, op3_pack, op4_search, op5_language_model, op6_quality, op7_token_counts, op8_ngram_join, op9_rules,
        op10_toxicity, op11_spelling, op12_exact_dedup, op13_alignment,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE, "op2_mix": mixing.ORACLE,
        "op11_spelling": spelling.ORACLE, "op12_exact_dedup": exact_dedup.ORACLE,
    }
