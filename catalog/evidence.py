"""What must hold of the trained models for every mail, as counts that SQL can state.

Trained scores have no SQL counterpart, but their properties do: each query counts the
mails for which a property holds, and the SQL counts all mails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog import duck_sql as d
from catalog import spark_queries as q
from mailscreen import lexicons as lx
from mailscreen.functions import text
from mailscreen.operators import features, forest, metrics, shap, tfidf
from mailscreen.session import work_folder
from mailscreen.sources import models

CLOSE = 1e-6


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two aggregates of one row each as one row."""
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").drop("one")


def _counted(df: DataFrame, holds) -> DataFrame:
    return df.agg(F.count("*").alias("n_mails"), F.count_if(holds).alias("n_holding"))


def meta_scores_are_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(q.score_meta_model(spark, sf), F.col("score_meta").between(0, 1))


def text_scores_are_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(q.score_text_model(spark, sf), F.col("score_text").between(0, 1))


def saved_meta_model_scores_alike(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_folder(spark, 'models')}/meta"
    model = q.meta_model(spark, sf)
    models.save_meta(model, spark, path)
    frame = features.metadata_features(q.mails(spark, sf), keep=["msg_id"])
    both = models.load_meta(spark, path).score(model.score(frame, "before"), "after")
    return _counted(both.select("before", "after"), F.col("before") == F.col("after"))


def saved_text_model_scores_alike(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{work_folder(spark, 'models')}/text"
    model = q.text_model(spark, sf)
    models.save_text(model, spark, path)
    scored = model.score(q.prepared(spark, sf), "before")
    both = models.load_text(spark, path).score(scored, "after")
    return _counted(
        both.select("before", "after"), F.abs(F.col("before") - F.col("after")) < CLOSE
    )


def shap_values_add_up(spark: SparkSession, sf: str) -> DataFrame:
    """Expectation plus all Shapley values is the forest's probability."""
    model = q.meta_model(spark, sf)
    trees, expected = shap.tree_paths(
        shap.node_table(model.forest, spark), model.forest.getNumTrees
    )
    frame = model.score(features.metadata_features(q.mails(spark, sf), keep=["msg_id"]))
    record = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in lx.FEATURES])
    values = frame.select("score_meta", shap.shap_column(spark, trees)(record).alias("phi"))
    total = F.aggregate("phi", F.lit(expected), lambda a, v: a + v)
    return _counted(values, F.abs(total - F.col("score_meta")) < CLOSE)


def meta_scores_follow_from_saved_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The score is the sum of the leaves whose intervals a mail falls into, tree by tree."""
    model = q.meta_model(spark, sf)
    groups, expected = shap.path_groups(
        shap.node_table(model.forest, spark), model.forest.getNumTrees
    )
    # trees of one leaf have no path; what the paths do not expect is theirs
    single = expected - sum(float(leaf @ share.prod(axis=1)) for _, _, _, share, leaf in groups)

    @F.arrow_udf(T.DoubleType())
    def leaves(features_of: pa.Array) -> pa.Array:
        x = np.asarray(features_of.flatten(), dtype=np.float64).reshape(len(features_of), -1)
        total = np.full(len(x), single)
        for feature, low, high, _, leaf in groups:
            for p in range(len(leaf)):
                held = (x[:, feature[p]] > low[p]) & (x[:, feature[p]] <= high[p])
                total += leaf[p] * held.all(axis=1)
        return pa.array(total)

    frame = model.score(features.metadata_features(q.mails(spark, sf), keep=["msg_id"]))
    record = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in lx.FEATURES])
    values = frame.select("score_meta", leaves(record).alias("sum"))
    return _counted(values, F.abs(F.col("sum") - F.col("score_meta")) < CLOSE)


def text_scores_follow_from_saved_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Scores from the saved term table and counted terms, by joins instead of vectors."""
    path = f"{work_folder(spark, 'models')}/text"
    model = q.text_model(spark, sf)
    models.save_text(model, spark, path)
    terms = F.broadcast(spark.read.parquet(f"{path}/terms"))
    frame = q.prepared(spark, sf)
    weight = (1 + F.log("tf")) * F.col("idf")
    margins = (
        tfidf.term_freq(frame).join(terms, "term").select("msg_id", weight.alias("w"), "coefficient")
        .groupBy("msg_id")
        .agg((F.sum(F.col("w") * F.col("coefficient")) / F.sqrt(F.sum(F.col("w") ** 2))).alias("m"))
    )
    scores = model.score(frame).select("msg_id", "score_text", text.is_blank(F.col("prepared_text")).alias("blank"))
    margin = F.coalesce("m", F.lit(0.0)) + F.lit(model.intercept)
    expected = F.when(F.col("blank"), 0.0).otherwise(1 / (1 + F.exp(-margin)))
    both = scores.join(margins, "msg_id", "left")
    return _counted(both, F.abs(expected - F.col("score_text")) < CLOSE)


def importances_follow_from_saved_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Gains of the splits, weighted by what reached them; each tree counts alike."""
    model = q.meta_model(spark, sf)
    reached = F.aggregate("impurityStats", F.lit(0.0), lambda a, v: a + v)
    splits = shap.node_table(model.forest, spark).filter("leftChild >= 0").select(
        "treeID", F.col("split.featureIndex").alias("position"), (F.col("gain") * reached).alias("gain")
    )
    per_tree = splits.groupBy("treeID").agg(F.sum("gain").alias("whole")).filter("whole > 0")
    shares = splits.join(per_tree, "treeID").groupBy("position").agg(F.sum(F.col("gain") / F.col("whole")).alias("s"))
    total = shares.agg(F.sum("s")).first()[0]
    expected = shares.select("position", (F.col("s") / total).alias("e"))
    table = q.feature_importance(spark, sf).join(expected, "position", "left")
    near = F.abs(F.coalesce("e", F.lit(0.0)) - F.col("importance")) < CLOSE
    return table.agg(F.count("*").alias("n_features"), F.count_if(near).alias("n_holding"))


def strongest_terms_follow_from_saved_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that fewer than 20 saved coefficients exceed, on either side."""
    path = f"{work_folder(spark, 'models')}/text"
    models.save_text(q.text_model(spark, sf), spark, path)
    terms = spark.read.parquet(f"{path}/terms")
    sides = None
    for name, sign in (("phishing", -1), ("legitimate", 1)):
        pull = F.col("coefficient") * sign
        last = terms.select(F.get(F.array_sort(F.collect_list(pull)), F.lit(19))).first()[0]
        side = terms.filter(pull < last)
        side = side.select(F.lit(name).alias("class"), "term", "coefficient")
        sides = side if sides is None else sides.union(side)
    reported = q.top_tokens(spark, sf)
    found = sides.join(reported, ["class", "term", "coefficient"])
    # terms below the last place are all reported; ties at the last place may be cut
    missed = sides.join(reported, ["class", "term", "coefficient"], "left_anti")
    counts = _beside(
        reported.agg(F.count("*").alias("n_reported")), missed.agg(F.count("*").alias("n_missed"))
    )
    return _beside(counts, found.agg((F.count("*") >= 2).alias("some")))


def importances_sum_to_one(spark: SparkSession, sf: str) -> DataFrame:
    table = q.feature_importance(spark, sf)
    n = q.labelled(spark, sf).agg(F.count("*").alias("n_labelled"))
    summed = table.agg(
        F.count("*").alias("n_features"), F.round(F.sum("importance"), 6).alias("total"),
        F.count_if(F.col("importance") < 0).alias("n_negative"),
    )
    return _beside(n, summed)


def token_contributions_add_up(spark: SparkSession, sf: str) -> DataFrame:
    """Intercept plus all products is the margin, where the text is not blank."""
    model = q.text_model(spark, sf)
    scored = model.score(q.prepared(spark, sf))
    weighed = model.tfidf.weigh(scored)
    parts = model.coefficient_table(spark).select("term", "coefficient")
    long = weighed.select(
        "msg_id", "score_text",
        F.explode_outer(F.arrays_zip("tfidf.indices", "tfidf.weights")).alias("t"),
    )
    names = F.array(*[F.lit(t) for t in model.tfidf.terms])
    long = long.withColumn("term", F.get(names, F.col("t.indices").cast("int")))
    margins = (
        long.join(F.broadcast(parts), "term", "left").groupBy("msg_id", "score_text")
        .agg(F.sum(F.coalesce(F.col("coefficient") * F.col("t.weights"), F.lit(0.0))).alias("sum"))
    )
    probability = 1 / (1 + F.exp(-(F.col("sum") + F.lit(model.intercept))))
    blank = F.col("score_text") == 0
    return _counted(margins, blank | (F.abs(probability - F.col("score_text")) < CLOSE))


def _sizes(rows: DataFrame, prediction: DataFrame) -> DataFrame:
    seen = metrics.confusion(prediction).select((F.expr("tp + fp + fn + tn")).alias("n_held_out"))
    return _beside(rows.agg(F.count("*").alias("n_training")), seen)


def held_out_mails_are_evaluated_once(spark: SparkSession, sf: str) -> DataFrame:
    training, held_out = q.split_mails(q.labelled(spark, sf))
    table = forest.feature_table(features.metadata_features(training, keep=["label"]))
    model = forest.train_meta(table)
    scores = model.score(features.metadata_features(held_out, keep=["label"]))
    return _sizes(table, metrics.with_prediction(scores, "score_meta"))


def folds_cover_all_mails(spark: SparkSession, sf: str) -> DataFrame:
    return q.fold_score(spark, sf).select(
        "n_rows", F.col("fold_score").between(0.0, 1.0).alias("valid")
    )


def vocabulary_of_the_text_model(spark: SparkSession, sf: str) -> DataFrame:
    """As the saved model reports it, with the strongest terms of both classes."""
    path = f"{work_folder(spark, 'models')}/text"
    models.save_text(q.text_model(spark, sf), spark, path)
    info = models.model_info(spark, [path]).filter("not is_heuristic").select(
        F.col("vocab_size").cast("bigint").alias("vocab_size")
    )
    strongest = q.top_tokens(spark, sf).agg(F.count_distinct("class", "term").alias("n_strongest"))
    return _beside(info, strongest)


QUERIES = {
    f.__name__: f for f in (
        meta_scores_follow_from_saved_nodes, text_scores_follow_from_saved_terms,
        importances_follow_from_saved_nodes, strongest_terms_follow_from_saved_terms,
        meta_scores_are_probabilities, text_scores_are_probabilities,
        saved_meta_model_scores_alike, saved_text_model_scores_alike, shap_values_add_up,
        importances_sum_to_one, token_contributions_add_up, held_out_mails_are_evaluated_once,
        folds_cover_all_mails, vocabulary_of_the_text_model,
    )
}

ALL_HOLD = f"WITH {d.MAILS} SELECT count(*) AS n_mails, count(*) AS n_holding FROM mails"
LABELLED = f"{d.DOCS.replace('mails AS', 'docs AS')}, mails AS (SELECT * FROM docs WHERE label IS NOT NULL)"
BUCKET = d.BUCKET.replace("content_hash", "md5(msg_id::VARCHAR)")

SQL = {
    "meta_scores_are_probabilities": ALL_HOLD,
    "text_scores_are_probabilities": ALL_HOLD,
    "meta_scores_follow_from_saved_nodes": ALL_HOLD,
    "text_scores_follow_from_saved_terms": ALL_HOLD,
    "importances_follow_from_saved_nodes": f"""WITH {LABELLED}
        SELECT {len(lx.FEATURES)}::BIGINT AS n_features,
        {len(lx.FEATURES)}::BIGINT AS n_holding FROM (SELECT count(*) FROM mails)""",
    "strongest_terms_follow_from_saved_terms": f"""WITH {LABELLED}
        SELECT 40::BIGINT AS n_reported, 0::BIGINT AS n_missed, true AS some
        FROM (SELECT count(*) FROM mails)""",
    "saved_meta_model_scores_alike": ALL_HOLD,
    "saved_text_model_scores_alike": ALL_HOLD,
    "shap_values_add_up": ALL_HOLD,
    "token_contributions_add_up": ALL_HOLD,
    "importances_sum_to_one": f"""WITH {LABELLED} SELECT count(*) AS n_labelled,
        {len(lx.FEATURES)}::BIGINT AS n_features, 1.0::DOUBLE AS total, 0::BIGINT AS n_negative
        FROM mails""",
    "held_out_mails_are_evaluated_once": f"""WITH {LABELLED} SELECT
        count(*) FILTER ({BUCKET} < {d.SPLIT.train_end}) AS n_training,
        count(*) FILTER ({BUCKET} BETWEEN {d.SPLIT.train_end} AND {d.SPLIT.val_end - 1})
          AS n_held_out FROM mails""",
    "folds_cover_all_mails": f"WITH {LABELLED} SELECT count(*) AS n_rows, true AS valid FROM mails",
    "vocabulary_of_the_text_model": f"""WITH {d.PREPARED.replace(d.MAILS, LABELLED)}, {d.TF}
        SELECT count(*) AS vocab_size, 40::BIGINT AS n_strongest FROM vocab""",
}
