"""A pipeline over documents: each stage works on what the one before it kept.

The last stage returns tokens; the others return the columns of documents. Where a stage changes texts,
n_chars follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm import byte_bpe, decontamination, line_dedup, near_dedup, quality
from hostlake.llm.common import prepare, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    found = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return found.where("accepted").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except from the document of smallest id. A document that loses all its lines goes."""
    prepare(spark)
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    kept = found.where((F.col("n_dropped") == 0) | (F.col("kept_text") != ""))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    chars = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("kept_text").cast("bigint"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    prepare(spark)
    return near_dedup.near_duplicates(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    prepare(spark)
    found = decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def byte_bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text back."""
    prepare(spark)
    coded = byte_bpe.code(docs.select(*COLUMNS), BYTE_RANKS, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("bigint").alias("n_tokens"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_bpe_coding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: Neither a language model nor byte-pair merges can be expressed in SQL.
ORACLE_SQL = None
