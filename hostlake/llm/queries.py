"""Registered queries of the operators: each applies one, as it would run in production, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlake.llm import (
    byte_bpe,
    conversation_repair,
    cross_polytope,
    decontamination,
    hard_negatives,
    line_dedup,
    lm_scoring,
    near_dedup,
    oracles,
    piece_bpe,
    quality,
    sharding,
    substring_dedup,
    token_counts,
)
from hostlake.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.code(docs, BYTE_RANKS, public_tokenizers.PATTERN, without=["text"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, size=4).select("doc_id", "n_shingles", "component_id", "kept")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"))


def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lm_scoring.score_texts(docs, PIECES).drop("lang")


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        sharding.text_size(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    return sharding.shard(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = quality.classify(docs, table(spark, sf_dir, "labels"), without=["text"])
    measures = [*quality.PERPLEXITIES, *quality.PERPLEXITIES.values()]
    return found.select("doc_id", "lang", "n_tokens", "n_distinct", *measures, "accepted")


def op8_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, PIECES, without=["text"]).select("doc_id", "n_pretokens", "n_tokens")


def op9_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup.dedup_substrings(docs, without=["text"])
    return found.select("doc_id", "n_words", "n_removed", sha256(F.col("kept_text")).alias("kept_sha256"))


def op10_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs)
    return found.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


def op11_bidirectional_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(turns), turns)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_bpe.code(docs, PIECES, without=["text"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
        "agrees",
    )


def op13_zone_map_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_subword_lattice": op5_subword_lattice,
    "op6_sampled_splitters": op6_sampled_splitters,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_trie_counts": op8_trie_counts,
    "op9_super_kmers": op9_super_kmers,
    "op10_perfect_hash": op10_perfect_hash,
    "op11_bidirectional_repair": op11_bidirectional_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_zone_map_negatives": op13_zone_map_negatives,
}

#: The others depend on merges, models, hashes or draws that SQL cannot express; tests hold them against
#: plain Python.
ORACLE_SQL: dict[str, str] = {
    "op1_winnowing": oracles.OP1,
    "op3_circulant_minhash": oracles.OP3,
    "op9_super_kmers": oracles.OP9,
    "op10_perfect_hash": oracles.OP10,
    "op13_zone_map_negatives": oracles.OP13,
}
