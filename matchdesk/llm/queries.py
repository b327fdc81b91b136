"""Registered queries of the corpus operators: each applies one operator, with its
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bpe, decontaminate, exact_dedup, html_text, language_id, line_dedup, minhash_dedup
from . import conversation_repair, lz_fingerprint, suffix_dedup, token_alignment, token_files, training_order


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of the written shards of BPE ids: doc_id, seq, slot, n_tokens, shard, offset."""
    _, manifest = training_order.write_token_order(read_table(spark, sf_dir, "documents"))
    return manifest.withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def token_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of decoded documents."""
    text = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(text, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"))))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_dedup(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_document_tokens(read_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.with_next(read_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, present="present")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_exact_dedup, op3_html_extraction, op4_decontamination, op5_training_order, op6_line_dedup,
    op7_byte_bpe, op8_minhash_dedup, op9_token_counts, op10_suffix_dedup,
    op11_lz_fingerprint, op12_conversation_repair, op13_token_alignment)}

ORACLE = {"op2_exact_dedup": exact_dedup.ORACLE, "op4_decontamination": decontaminate.ORACLE,
          "op6_line_dedup": line_dedup.ORACLE}
