"""Random forest on the metadata features: training, scoring, importances, estimates."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.operators import corpus as corpora
from mailscreen.operators.features import as_numbers, feature_vector
from mailscreen.operators.scoring import SCORE_META, Scorer
from mailscreen.params import ForestParams
from mailscreen.session import work_folder

SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class ForestModel:
    forest: RandomForestClassificationModel
    trained_at: str
    estimator: str = "RandomForestClassifier"
    schema_version: str = SCHEMA_VERSION
    feature_names: tuple[str, ...] = lx.FEATURES
    train_metrics: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.forest.numClasses < 2:
            raise ValueError("the forest never saw a phishing label")

    @property
    def name(self) -> str:
        return f"{self.estimator}_meta_v{self.schema_version}_{self.trained_at}"

    def score(self, df: DataFrame, output: str = SCORE_META) -> DataFrame:
        """Append the phishing probability; label 1 has index 1 in the class vector."""
        keep = df.columns
        scored = self.forest.transform(feature_vector(df, self.forest.getFeaturesCol()))
        probability = F.get(vector_to_array(self.forest.getProbabilityCol()), F.lit(1))
        return scored.select(*keep, probability.alias(output))

    def scorer(self) -> Scorer:
        return Scorer(self.name, self.score)

    def feature_importance(self, spark: SparkSession, top_k: int | None = None) -> DataFrame:
        """Impurity importances, largest first; ties keep the canonical feature order."""
        rows = [
            (i, n, float(v))
            for i, (n, v) in enumerate(
                zip(self.feature_names, self.forest.featureImportances.toArray())
            )
        ]
        table = spark.createDataFrame(rows, "position int, feature string, importance double")
        ordered = table.orderBy(F.desc("importance"), "position")
        return ordered if top_k is None else ordered.limit(top_k)


def feature_table(features: DataFrame) -> DataFrame:
    """Write features and labels to the work folder and read them back.

    Tree training passes over its input several times; it should pass over 33 narrow
    columns, not over the text they come from, also after losing an executor.
    """
    path = work_folder(features.sparkSession, "feature-table")
    as_numbers(features.select("label", *lx.FEATURES)).write.parquet(path)
    return features.sparkSession.read.parquet(path)


def _estimator(params: ForestParams, num_trees: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(
        numTrees=num_trees,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_leaf,
        featureSubsetStrategy=params.features_per_split,
        maxBins=params.max_bins,
        impurity="gini",
        weightCol="weight",
        seed=seed,
    )


def _weighted(table: DataFrame) -> DataFrame:
    return feature_vector(corpora.with_class_weight(table)).select(
        F.col("label").cast("double").alias("label"), "weight", "features"
    )


def _fit(table: DataFrame, params: ForestParams, num_trees: int, seed: int):
    return _estimator(params, num_trees, seed).fit(_weighted(table))


def train_meta(table: DataFrame, params: ForestParams = ForestParams()) -> ForestModel:
    """Fit the forest on a table of the 32 features and ``label`` (see feature_table)."""
    return ForestModel(
        forest=_fit(table, params, params.num_trees, params.seed),
        trained_at=datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
    )


def bag_count(bag: int, seed: int) -> Column:
    """How often a row is drawn into a bag: Poisson with mean 1, from the row's hash.

    A row's share of every bag can thus be told again at any time, from the row alone.
    """
    hashed = F.xxhash64(F.lit(f"bag {bag} of {seed}"), "label", *lx.FEATURES)
    draw = F.shiftrightunsigned(hashed, 11) / F.lit(2.0**53)
    term = upto = math.exp(-1)
    count = F.lit(0)
    for k in range(1, 16):  # the chance of more than 15 is below 1e-13
        count = count + (draw >= upto).cast("int")
        term /= k
        upto += term
    return count


def bagged_forests(table: DataFrame, params: ForestParams = ForestParams()) -> list:
    """(bag, forest) of every bag; a bag's trees differ in the features they try.

    Rows come as often as they were drawn, as a weight. Forests are fitted side by side, so
    that the small jobs of one level of one forest do not leave the cluster idle.
    """
    weighted = feature_vector(corpora.with_class_weight(table))
    sizes = [params.trees_per_bag] * (params.num_trees // params.trees_per_bag)
    if rest := params.num_trees % params.trees_per_bag:
        sizes.append(rest)

    def fit(bag: int):
        drawn = weighted.withColumn("drawn", bag_count(bag, params.seed)).filter("drawn > 0")
        rows = drawn.select(
            F.col("label").cast("double").alias("label"),
            (F.col("weight") * F.col("drawn")).alias("weight"), "features",
        )
        estimator = _estimator(params, sizes[bag], params.seed + bag)
        return estimator.setBootstrap(False).fit(rows)

    target = inheritable_thread_target(table.sparkSession)(fit)
    with ThreadPoolExecutor(params.fits_at_once) as pool:
        return list(enumerate(pool.map(target, range(len(sizes)))))


def out_of_bag_votes(table: DataFrame, forests: list, params: ForestParams) -> DataFrame:
    """label and votes per class of the trees whose bag left the row out, in one narrow pass."""
    rows = feature_vector(table)
    votes = [F.lit(0.0), F.lit(0.0)]
    for bag, forest in forests:
        columns = [f"_{kind}_{bag}" for kind in ("raw", "probability", "prediction")]
        forest = forest.setRawPredictionCol(columns[0]).setProbabilityCol(columns[1])
        rows = forest.setPredictionCol("").transform(rows)
        raw = vector_to_array(columns[0])
        left_out = bag_count(bag, params.seed) == 0
        votes = [v + F.when(left_out, F.get(raw, F.lit(c))).otherwise(0.0) for c, v in enumerate(votes)]
    return rows.select("label", votes[0].alias("votes_0"), votes[1].alias("votes_1"))


def oob_score(table: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """Accuracy on every row of the trees that were grown without it.

    Equal rows are drawn together, so a row's copy never stands in a bag that left the row
    out. Rows that no bag left out (one in 100,000 at 25 bags) have no vote and do not count.
    """
    forests = bagged_forests(table, params)
    votes = out_of_bag_votes(table, forests, params)
    right = F.col("label") == (F.col("votes_1") > F.col("votes_0")).cast("int")
    voted = F.col("votes_0") + F.col("votes_1") > 0
    return votes.agg(
        F.count("*").alias("n_rows"), F.count_if(voted).alias("n_voted"),
        F.avg(F.when(voted, right.cast("double"))).alias("oob_score"),
    )


def fold_score(table: DataFrame, params: ForestParams = ForestParams()) -> DataFrame:
    """Accuracy on hash folds that the scoring trees have not seen.

    The forest is grown in groups: each leaves out one fold and votes on that fold.
    Identical rows share a fold, and together the groups have as many trees as the forest.
    """
    fold = F.pmod(F.xxhash64(*lx.FEATURES), F.lit(params.oob_folds))
    votes = None
    for g in range(params.oob_folds):
        # the first groups take one tree more where trees do not divide evenly
        n_trees = params.num_trees // params.oob_folds + (g < params.num_trees % params.oob_folds)
        if n_trees == 0:
            continue
        forest = _fit(table.filter(fold != g), params, n_trees, params.seed + g)
        held_out = feature_vector(table.filter(fold == g)).select("label", "features")
        scored = forest.transform(held_out).select("label", "prediction")
        votes = scored if votes is None else votes.unionByName(scored)
    return votes.agg(
        F.count("*").alias("n_rows"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("fold_score"),
    )
