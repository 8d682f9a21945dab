"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of documents. ``run`` writes each stage's rows to the shared folder and reads them again, so a
lost executor costs one stage at most.

Rows keep the five columns of documents; a table's further columns, whatever their names, end at the first stage. Null ids and ids that
several texts share are rows like others, null texts count as empty, texts of any length are worked on whole, repeated rows count each
until near copies go, and an empty table gives an empty result of every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm.line_dedup import dedup_lines
from poolscope.llm.mixing import mix
from poolscope.llm.ngram_join import keep_one
from poolscope.llm.packing import pack
from poolscope.llm.quality import keep_good
from poolscope.session import settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least five of these documents repeat, save in the last one."""
    kept = dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies, the one with the least id (null last), once; other texts of that id stay."""
    return keep_one(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shard by shard."""
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_join", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: Tokens, discriminants and near copies aren't expressions of SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
