"""The screening job: features, metadata score, gate, text score, fusion, decision.

The plan is a single narrow pass. Gated mails are not split off into a branch of their
own: a filter on a computed score would make Spark read and clean every mail twice, or
cache bodies. Instead a gated mail enters the text stage with empty text, which costs a
text scorer next to nothing, and its text score is nulled afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.functions import text
from mailscreen.operators import scoring
from mailscreen.operators.features import feature_record, metadata_features
from mailscreen.operators.scoring import HEURISTIC_META, HEURISTIC_TEXT, Scorer
from mailscreen.params import ScreenParams, TextOptions
from mailscreen.session import settled

HEURISTIC_WARNING = (
    "At least one active scorer is heuristic; its scores do not come from a trained model."
)


def score_stages(
    df: DataFrame,
    params: ScreenParams = ScreenParams(),
    meta_scorer: Scorer = HEURISTIC_META,
    text_scorer: Scorer = HEURISTIC_TEXT,
    options: TextOptions = TextOptions(),
    keep: list[str] | None = None,
    in_kernel: bool = False,
) -> DataFrame:
    """Feature columns, both scores, the gate flag and the unrounded final score."""
    features = metadata_features(df, options, keep, in_kernel)
    meta = scoring.checked(meta_scorer, features, scoring.SCORE_META)
    gated = meta.withColumn(
        "gated", scoring.gate(F.col(scoring.SCORE_META), params.gate_threshold)
    )
    prepared = gated.withColumn(
        "prepared_text",
        F.when(F.col("gated"), "").otherwise(
            text.prepare_text(F.col("subject_clean"), F.col("body_clean"), options)
        ),
    ).drop("subject_clean", "body_clean")
    scored = scoring.checked(text_scorer, prepared, scoring.SCORE_TEXT)
    score_text = F.when(~F.col("gated"), F.col(scoring.SCORE_TEXT))
    final = scored.withColumn(scoring.SCORE_TEXT, score_text).withColumn(
        "score_final",
        F.when(F.col("gated"), F.col(scoring.SCORE_META)).otherwise(
            scoring.fuse(F.col(scoring.SCORE_META), F.col(scoring.SCORE_TEXT), params.alpha)
        ),
    )
    return settled(final, "scores")


def classify(
    df: DataFrame,
    params: ScreenParams = ScreenParams(),
    meta_scorer: Scorer = HEURISTIC_META,
    text_scorer: Scorer = HEURISTIC_TEXT,
    options: TextOptions = TextOptions(),
    keep: list[str] | None = None,
    explainer=None,
    where: Column | str | None = None,
    in_kernel: bool = False,
) -> DataFrame:
    """Prediction records for a frame with ``subject`` and ``body``.

    ``where`` picks the mails to screen by their own columns. It stands below the first
    stage, so it prunes partitions and row groups at the scan; a filter on the records stops
    at the stages (see ``session.settled``), which it must not repeat, and screens every mail.

    ``in_kernel`` counts in the Arrow stage of the entropies, which is faster where all
    features are wanted; without it, records without features need no such stage.

    ``explainer`` is a function that appends ``explanation_items`` (ordered array of
    feature and value) to the scored frame, for instance from
    :func:`mailscreen.operators.shap.explainer`; without one, explanations are null.
    """
    keep = [c for c in df.columns if c not in ("subject", "body")] if keep is None else keep
    if where is not None:
        df = df.filter(where)
    scored = score_stages(df, params, meta_scorer, text_scorer, options, keep, in_kernel)
    if explainer is not None and params.explain:
        scored = explainer(scored, params.top_k)
        items = F.when(F.size("explanation_items") > 0, F.col("explanation_items"))
    else:
        items = F.lit(None).cast("array<struct<feature:string,value:double>>")
    label = scoring.label_decision(F.col("score_final"), params.decision_threshold)
    return scored.select(
        *keep,
        label.alias("label_predicted"),
        (label == "phishing").alias("is_phishing"),
        F.round("score_final", 6).alias("score_final"),
        F.round(scoring.SCORE_META, 6).alias("score_meta"),
        F.round(scoring.SCORE_TEXT, 6).alias("score_text"),
        F.struct(
            F.col("gated").alias("activated"),
            F.col(scoring.SCORE_META).alias("score_meta"),
            F.lit(params.gate_threshold).alias("threshold"),
        ).alias("gating"),
        feature_record().alias("metadata_features"),
        "prepared_text",
        F.lit(meta_scorer.name).alias("meta_model_name"),
        F.when(~F.col("gated"), text_scorer.name).alias("text_model_name"),
        F.map_from_entries(items).alias("explanation"),
        items.alias("explanation_items"),
    )


def uses_heuristics(meta_scorer: Scorer, text_scorer: Scorer) -> bool:
    return meta_scorer.is_heuristic or text_scorer.is_heuristic


def response(
    predictions: DataFrame,
    keep: list[str],
    meta_scorer: Scorer = HEURISTIC_META,
    text_scorer: Scorer = HEURISTIC_TEXT,
) -> DataFrame:
    """The outward record: everything but the prepared text, plus the heuristic notice."""
    warning: Column = (
        F.lit(HEURISTIC_WARNING)
        if uses_heuristics(meta_scorer, text_scorer)
        else F.lit(None).cast("string")
    )
    return predictions.select(
        *keep, F.col("label_predicted").alias("label"), "is_phishing", "score_final",
        "score_meta", "score_text", "gating", "metadata_features", "meta_model_name",
        "text_model_name", warning.alias("warning"), "explanation",
    )


def flat_features(predictions: DataFrame, keep: list[str]) -> DataFrame:
    """Feature struct as columns, for writers that want flat tables."""
    return predictions.select(*keep, *(f"metadata_features.{n}" for n in lx.FEATURES))
