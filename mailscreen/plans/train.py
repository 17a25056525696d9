"""Training jobs: split in, evaluated and saved model out."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from mailscreen.operators import features, forest, metrics, textmodel
from mailscreen.params import ForestParams, TextModelParams, TextOptions
from mailscreen.session import work_folder
from mailscreen.sources import models


def _written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the work folder, for jobs that read it several times."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _evaluate(scored: DataFrame, score: str) -> dict[str, float]:
    """Metrics of a scored validation split."""
    table = _written(scored.select("label", score), "scores")
    if not metrics.smoke_scores(table, score).first().valid:
        raise RuntimeError(f"{score} leaves [0, 1]")
    m = metrics.eval_binary(metrics.with_prediction(table, score)).first().asDict()
    m["roc_auc"] = metrics.roc_auc(table, score).first().roc_auc
    return m


def run_meta(
    spark: SparkSession,
    train: DataFrame,
    val: DataFrame,
    path: str,
    params: ForestParams = ForestParams(),
    force: bool = False,
) -> forest.ForestModel:
    """Train, evaluate and save the metadata forest; reuse a saved one unless forced."""
    try:
        if not force:
            return models.load_meta(spark, path)
    except FileNotFoundError:
        pass
    table = forest.feature_table(features.metadata_features(train, keep=["label"]))
    model = forest.train_meta(table, params)
    measured = _evaluate(
        model.score(features.metadata_features(val, keep=["label"])), "score_meta"
    )
    measured["oob_score"] = forest.oob_score(table, params).first().oob_score
    models.save_meta(replace(model, train_metrics=measured), spark, path, force=True)
    return models.load_meta(spark, path)


def run_text(
    spark: SparkSession,
    train: DataFrame,
    val: DataFrame,
    path: str,
    params: TextModelParams = TextModelParams(),
    options: TextOptions = TextOptions(),
    force: bool = False,
) -> textmodel.TextModel:
    """Train, evaluate and save the text model; reuse a saved one unless forced."""
    try:
        if not force:
            return models.load_text(spark, path)
    except FileNotFoundError:
        pass
    corpus = features.text_corpus(train, options, keep=["label"])
    model = textmodel.train_text(corpus, params, options)
    measured = _evaluate(
        model.score(features.text_corpus(val, options, keep=["label"])), "score_text"
    )
    models.save_text(replace(model, train_metrics=measured), spark, path, force=True)
    return models.load_text(spark, path)
