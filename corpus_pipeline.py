"""Cleaning a corpus in stages, each one an operator over all that its predecessor kept.

Every stage but the last returns the columns of the documents it was given. Between stages
the documents are written to the shared folder and read again, so that a lost executor
costs one stage at most.

SQL cannot express the first stage, which estimates the rules' accuracies by iteration, so
there is no ORACLE_SQL; tests hold each stage against a plain Python version.

Defined results, in every stage: null and empty texts are documents without words, which the
first stage rejects and the others keep, but for copies of one another; very long texts are
read whole; of repeated rows one stays after near-dedup; null ids, languages and sources are
values like any other; an empty table stays empty; further columns pass through, also those
named as a stage might name its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from mailscreen.llm.staging import WORD, written


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are probably bad go."""
    return quality_rules.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages go; a document of which no word is left goes with them."""
    done = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_deleted") > 0) & ~F.rlike("text", F.lit(WORD))
    done = done.filter(~F.coalesce(emptied, F.lit(False)))
    cut = F.when(F.col("n_deleted") > 0, F.char_length("text").cast("long"))
    return done.withColumn("n_chars", F.coalesce(cut, "n_chars")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a span of words with the benchmark go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their targets."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", apply_quality_rules),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
