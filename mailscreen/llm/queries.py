"""One query per operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen.llm import (
    decontamination, html_extract, license_scan, line_dedup, mixing, prefix_trie,
    quality_ranker, quality_rules, secret_scan, simhash, token_counts, turn_repair, warc,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf, "documents"))


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, sf, "documents"), table(spark, sf, "benchmark")
    )
    return found.drop("text_hash", "spans")


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.components(table(spark, sf, "documents")).drop("text_hash", "root")


def op5_html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf, "pages"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    found = quality_rules.quality(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "p_good", "kept",
    )


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages")).drop("payload")


def op8_quality_ranker(spark: SparkSession, sf: str) -> DataFrame:
    return quality_ranker.ranked(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf, "documents"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary)


def op11_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf, "documents"))


def op12_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repaired(table(spark, sf, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf, "conversations"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_html_extract": op5_html_extract,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_quality_ranker": op8_quality_ranker,
    "op9_mix": op9_mix,
    "op10_token_counts": op10_token_counts,
    "op11_licenses": op11_licenses,
    "op12_turn_repair": op12_turn_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
