"""Scorer protocol, gating, fusion and the label decision."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.operators import heuristics
from mailscreen.params import ScreenParams

SCORE_META = "score_meta"
SCORE_TEXT = "score_text"


@dataclass(frozen=True)
class Scorer:
    """Anything that appends one probability column to a frame.

    A metadata scorer sees the 32 feature columns and appends ``score_meta``; a text
    scorer sees ``prepared_text`` and appends ``score_text``. ``apply`` may use native
    expressions, a Spark ML model or a vectorised UDF.
    """

    name: str
    apply: Callable[[DataFrame], DataFrame]
    is_heuristic: bool = False


HEURISTIC_META = Scorer(
    "heuristic_meta_v1",
    lambda df: df.withColumn(SCORE_META, heuristics.meta_score()),
    is_heuristic=True,
)
HEURISTIC_TEXT = Scorer(
    "heuristic_text_v1",
    lambda df: df.withColumn(SCORE_TEXT, heuristics.text_score(F.col("prepared_text"))),
    is_heuristic=True,
)


def checked(scorer: Scorer, df: DataFrame, column: str) -> DataFrame:
    """Apply a scorer, insist on its column, and clip what it returns to [0, 1]."""
    if not isinstance(scorer, Scorer):
        raise TypeError(f"expected a Scorer for {column}, got {type(scorer).__name__}")
    scored = scorer.apply(df)
    if column not in scored.columns:
        raise ValueError(f"scorer {scorer.name!r} did not append {column!r}")
    clipped = F.least(F.greatest(F.col(column).cast("double"), F.lit(0.0)), F.lit(1.0))
    return scored.withColumn(column, clipped)


def gate(score_meta: Column, threshold: float) -> Column:
    return score_meta >= F.lit(threshold)


def fuse(score_meta: Column, score_text: Column, alpha: float) -> Column:
    fused = F.lit(alpha) * score_meta + F.lit(1.0 - alpha) * score_text
    return F.least(F.greatest(fused, F.lit(0.0)), F.lit(1.0))


def label_decision(score: Column, threshold: float) -> Column:
    return F.when(score >= F.lit(threshold), "phishing").otherwise("legitimate")


def threshold_sweep(scored: DataFrame, grid: Iterable[ScreenParams]) -> DataFrame:
    """Decision counts for every parameter set of a grid, in one pass over the scores.

    ``scored`` carries ``score_meta`` and the ungated ``score_text`` and optionally
    ``label``. Every grid point becomes a handful of partial sums, so rows are never
    multiplied by the size of the grid.
    """
    grid = list(grid)
    known = F.col("label") if "label" in scored.columns else F.lit(None).cast("int")
    sums = []
    for i, p in enumerate(grid):
        gated = gate(F.col(SCORE_META), p.gate_threshold)
        final = F.when(gated, F.col(SCORE_META)).otherwise(
            fuse(F.col(SCORE_META), F.col(SCORE_TEXT), p.alpha)
        )
        positive = final >= p.decision_threshold
        sums += [
            F.count_if(gated).alias(f"gated_{i}"),
            F.count_if(positive).alias(f"phishing_{i}"),
            F.count_if(positive & (known == 1)).alias(f"tp_{i}"),
            F.count_if(positive & (known == 0)).alias(f"fp_{i}"),
        ]
    totals = scored.agg(*sums)
    points = F.array(
        *(
            F.struct(
                F.lit(p.gate_threshold).alias("gate_threshold"),
                F.lit(p.alpha).alias("alpha"),
                F.lit(p.decision_threshold).alias("decision_threshold"),
                F.col(f"gated_{i}").alias("n_gated"),
                F.col(f"phishing_{i}").alias("n_phishing"),
                F.col(f"tp_{i}").alias("true_positives"),
                F.col(f"fp_{i}").alias("false_positives"),
            )
            for i, p in enumerate(grid)
        )
    )
    return totals.select(F.explode(points).alias("p")).select("p.*")
