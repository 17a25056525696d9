"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.session import work_folder

# Characters that separate words in most operators: space and U+0009 to U+000D.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a read instead of a recomputation, and
    lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Mark a written table for broadcast if it has at most `most_rows` rows.

    The count is of the actual rows; beyond the bound the join shuffles, with the same
    result. The caller picks the bound from the width of a row.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def bundle(df: DataFrame) -> Column:
    """All columns of a frame as one, out of the way of columns that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("document")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z alone; other alphabets keep their case.

    `lower` does the same on pure ASCII and is far cheaper than `translate`.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, upper, lower)
    )


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def same_rows(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition on columns of equal name in which null equals null."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition
