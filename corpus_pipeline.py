"""Corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import langid
from causeway.llm.jaccard_join import HAS_WORD, one_of_each
from causeway.llm.line_dedup import line_dedup
from causeway.llm.packing import pack, token_pieces
from causeway.llm.substring_dedup import substring_dedup
from causeway.session import read_table, shared_folder


#: Words whose ids a worker keeps during packing; executors still hold much of the stages before.
WORDS_KEPT = 30_000


def _cleaned(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """The columns of ``docs`` after lines were cut: n_chars is that of the text that is left, and a
    document of which no word is left goes."""
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(HAS_WORD))
    chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    return (kept if chars is None else kept.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that occurred before."""
    return _cleaned(docs, line_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without paragraphs that occurred before, exactly or nearly."""
    return _cleaned(docs, substring_dedup(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, placed in sequences."""
    return pack(token_pieces(docs, most_kept=WORDS_KEPT, release=True))


STAGES = [("language_id", language_id), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("substring_dedup", paragraphs), ("best_fit_packing", packing)]
ORACLE_SQL = None  # tokenizers and learnt centroids are beyond SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
