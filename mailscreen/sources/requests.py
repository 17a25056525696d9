"""Mails handed in for scoring: validation without rejecting the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.functions import text
from mailscreen.params import RequestLimits


def validate(df: DataFrame, limits: RequestLimits = RequestLimits()) -> DataFrame:
    """Append ``reject_reason``, null for acceptable mails.

    Missing subject and sender count as empty; a missing or blank body does not.
    """
    def size(name: str):
        return F.length(F.col(name)) if name in df.columns else F.lit(0)

    body = F.col("body")
    reason = (
        F.when(body.isNull(), "body missing")
        .when(F.length(body) > limits.body, "body too long")
        .when(text.is_blank(body), "body blank")
        .when(size("subject") > limits.subject, "subject too long")
        .when(size("sender") > limits.sender, "sender too long")
    )
    return df.withColumn("reject_reason", reason)


def split_requests(
    df: DataFrame, limits: RequestLimits = RequestLimits()
) -> tuple[DataFrame, DataFrame]:
    """Acceptable mails, and rejected ones with their reason."""
    checked = validate(df, limits)
    return (
        checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        checked.filter(F.col("reject_reason").isNotNull()),
    )
