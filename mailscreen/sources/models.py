"""Model directories: a Spark-native artifact plus a one-row manifest table.

The manifest is written last, so a directory without one is an unfinished save.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.operators import forest, textmodel, tfidf
from mailscreen.operators.scoring import HEURISTIC_META, HEURISTIC_TEXT
from mailscreen.params import TextModelParams, TextOptions

_MANIFEST = (
    "kind string, name string, schema_version string, estimator string, trained_at string, "
    "feature_names array<string>, metrics map<string,double>, settings map<string,string>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def _write_manifest(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/manifest"
    )


def _should_write(spark: SparkSession, path: str, force: bool) -> bool:
    return force or not _exists(spark, f"{path}/manifest/_SUCCESS")


def save_meta(
    model: forest.ForestModel, spark: SparkSession, path: str, force: bool = False
) -> bool:
    """Save a forest; an existing artifact is left alone unless forced."""
    if not _should_write(spark, path, force):
        return False
    model.forest.write().overwrite().save(f"{path}/forest")
    _write_manifest(
        spark, path,
        ("meta", model.name, model.schema_version, model.estimator, model.trained_at,
         list(model.feature_names), model.train_metrics, {}),
    )
    return True


def save_text(
    model: textmodel.TextModel, spark: SparkSession, path: str, force: bool = False
) -> bool:
    """Save a text model as its term table; an existing artifact stays unless forced."""
    if not _should_write(spark, path, force):
        return False
    p, o = model.tfidf.params, model.options
    model.coefficient_table(spark).write.mode("overwrite").parquet(f"{path}/terms")
    settings = {
        "intercept": repr(model.intercept),
        "n_docs": str(model.tfidf.n_docs),
        "vocab_size": str(model.vocab_size),
        "vectorizer": json.dumps(vars(p)),
        "text": json.dumps(vars(o)),
    }
    _write_manifest(
        spark, path,
        ("text", model.name, model.schema_version, model.classifier, model.trained_at,
         None, model.train_metrics, settings),
    )
    return True


def manifest(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no model at {path}; train one first")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def feature_drift(spark: SparkSession, path: str) -> DataFrame:
    """Features the code has and the artifact lacks, and the other way round."""
    current = F.split(F.lit("\n".join(lx.FEATURES)), "\n")
    stored = F.coalesce("feature_names", F.array().cast("array<string>"))
    return manifest(spark, path).select(
        F.array_except(current, stored).alias("added"),
        F.array_except(stored, current).alias("removed"),
        (stored != current).alias("differs"),
    )


def _checked(spark: SparkSession, path: str, kind: str, version: str):
    row = manifest(spark, path).first()
    if row.kind != kind:
        raise TypeError(f"{path} holds a {row.kind!r} model, expected {kind!r}")
    if row.schema_version != version:
        raise ValueError(
            f"{path} has schema version {row.schema_version}, the code has {version}; retrain"
        )
    return row


def load_meta(spark: SparkSession, path: str) -> forest.ForestModel:
    row = _checked(spark, path, "meta", forest.SCHEMA_VERSION)
    drift = feature_drift(spark, path).first()
    if drift.differs:
        raise ValueError(
            f"{path} was trained on other features: added {drift.added}, removed {drift.removed}"
        )
    return forest.ForestModel(
        forest=RandomForestClassificationModel.load(f"{path}/forest"),
        trained_at=row.trained_at, estimator=row.estimator,
        schema_version=row.schema_version, feature_names=tuple(row.feature_names),
        train_metrics=dict(row.metrics),
    )


def load_text(spark: SparkSession, path: str) -> textmodel.TextModel:
    row = _checked(spark, path, "text", textmodel.SCHEMA_VERSION)
    # the term table is bounded by the vocabulary size
    terms = spark.read.parquet(f"{path}/terms").orderBy("term").collect()
    terms.sort(key=lambda t: t.term)
    return textmodel.TextModel(
        tfidf=tfidf.TfIdf(
            tuple(t.term for t in terms), tuple(t.idf for t in terms),
            int(row.settings["n_docs"]),
            TextModelParams(**json.loads(row.settings["vectorizer"])),
        ),
        coefficients=tuple(t.coefficient for t in terms),
        intercept=float(row.settings["intercept"]),
        trained_at=row.trained_at, classifier=row.estimator,
        schema_version=row.schema_version,
        options=TextOptions(**json.loads(row.settings["text"])),
        train_metrics=dict(row.metrics),
    )


def model_info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Names, versions, metrics and vectoriser settings of saved models."""
    tables = [manifest(spark, p) for p in paths]
    info = tables[0]
    for t in tables[1:]:
        info = info.unionByName(t)
    info = info.select(
        "kind", "name", "schema_version", "estimator", "trained_at", "metrics",
        F.try_element_at("settings", F.lit("vectorizer")).alias("vectorizer_params"),
        F.try_element_at("settings", F.lit("vocab_size")).cast("int").alias("vocab_size"),
        F.size(F.coalesce("feature_names", F.array().cast("array<string>"))).alias("n_features"),
        F.lit(False).alias("is_heuristic"),
    )
    # a kind without a saved model is scored by its heuristic
    names = [("meta", HEURISTIC_META.name), ("text", HEURISTIC_TEXT.name)]
    rules = spark.createDataFrame(names, "kind string, name string").join(info, "kind", "left_anti")
    return info.unionByName(
        rules.withColumn("is_heuristic", F.lit(True)), allowMissingColumns=True
    )
