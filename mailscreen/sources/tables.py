"""Parquet splits in, unified table and scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.operators.corpus import require_columns


def load_split(
    spark: SparkSession, path: str, name: str = "split", columns: tuple[str, ...] = ()
) -> DataFrame:
    """A labelled split: required columns checked, null texts emptied, label as int."""
    df = require_columns(spark.read.parquet(path), lx.SPLIT_COLUMNS, f"split {name!r}")
    return as_split(df, columns)


def as_split(df: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    return require_columns(df, lx.SPLIT_COLUMNS, "the split").select(
        *columns,
        F.coalesce(F.col("subject").cast("string"), F.lit("")).alias("subject"),
        F.coalesce(F.col("body").cast("string"), F.lit("")).alias("body"),
        F.col("label").cast("int").alias("label"),
    )


def save_unified(
    df: DataFrame, path: str, force: bool = False, partition_by: tuple[str, ...] = ()
) -> None:
    """Write the unified table; an existing one is left as it is unless forced.

    The commit protocol publishes files only when the job is complete. Partitioning by
    source lets a later ``isin`` on sources skip whole directories.
    """
    writer = df.write.mode("overwrite" if force else "ignore").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def only_sources(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named sources; a partition filter on a table partitioned by source."""
    return df.filter(F.col("dataset_source").isin(*names))


def save_scores(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write prediction or response records as Parquet or JSON."""
    df.write.mode(mode).format(fmt).save(path)
