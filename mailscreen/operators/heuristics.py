"""Heuristic scorers used while no trained model is at hand, and their explanation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.functions import text


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def _signal(name: str) -> Column:
    """A feature as a number in [0, 1]: ratios saturate above one half, counts at three."""
    value = F.col(name).cast("double")
    kind = lx.FEATURE_TYPES[name]
    if kind == "boolean":
        signal = value
    elif name.startswith("ratio_"):
        signal = F.when(value > 0.5, 1.0).otherwise(value)
    else:
        signal = F.when(value > 1, F.least(value, F.lit(3.0)) / 3.0).otherwise(value)
    return F.coalesce(signal, F.lit(0.0))


def _terms() -> dict[str, Column]:
    return {name: F.lit(weight) * _signal(name) for name, weight in lx.HEURISTIC_WEIGHTS.items()}


def meta_score() -> Column:
    """Weighted sum over 13 features, clipped to [0, 1]."""
    return _clip(reduce(lambda acc, term: acc + term, _terms().values(), F.lit(0.0)))


def text_score(prepared: Column) -> Column:
    """Share of persuasion terms among the words plus a bonus for their number."""
    def score(urgency: Column) -> Column:
        words = F.greatest(text.let(text.collapse_ws(prepared), text.word_count), F.lit(1))
        density = urgency / words
        base = F.least(density / lx.URGENCY_DENSITY_FULL, F.lit(1.0)) * lx.URGENCY_DENSITY_WEIGHT
        bonus = F.least(urgency / lx.URGENCY_COUNT_SCALE, F.lit(lx.URGENCY_COUNT_CAP))
        return F.least(base + bonus, F.lit(1.0))

    return F.when(text.is_blank(prepared), 0.0).otherwise(
        text.let(text.count_urgency(prepared), score)
    )


def contributions(top_k: int) -> Column:
    """The largest positive summands of the metadata score, largest first.

    The score is a plain sum, so the summands are its exact explanation. Ranking happens
    inside the row; ties keep the weight order.
    """
    terms = F.array(
        *(
            F.struct(F.lit(i).alias("rank"), F.lit(name).alias("feature"), term.alias("value"))
            for i, (name, term) in enumerate(_terms().items())
        )
    )
    positive = F.filter(terms, lambda t: t["value"] > 0)
    # sorting is ascending: negate the value, then the weight order breaks ties
    ordered = F.sort_array(
        F.transform(
            positive,
            lambda t: F.struct(
                (-t["value"]).alias("key"), t["rank"].alias("rank"),
                t["feature"].alias("feature"),
            ),
        )
    )
    return F.transform(
        F.slice(ordered, 1, top_k),
        lambda t: F.struct(
            t["feature"].alias("feature"), F.round(-t["key"], 6).alias("value")
        ),
    )


def explain_heuristic(features: DataFrame, top_k: int, keep: list[str]) -> DataFrame:
    """One row per mail and contributing feature, with its rank."""
    return features.select(
        *keep, F.posexplode(contributions(top_k)).alias("pos", "item")
    ).select(
        *keep,
        (F.col("pos") + 1).alias("rank"),
        F.col("item.feature").alias("feature"),
        F.col("item.value").alias("value"),
    )
