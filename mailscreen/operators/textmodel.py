"""Logistic regression over TF-IDF: training, scoring, tokens and contributions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.functions import text
from mailscreen.operators import corpus as corpora
from mailscreen.operators import tfidf
from mailscreen.operators.scoring import SCORE_TEXT, Scorer
from mailscreen.params import TextModelParams, TextOptions
from mailscreen.session import work_folder

SCHEMA_VERSION = "1.0"


def sparse_parts(size: int) -> Column:
    """The ``tfidf`` column in the sparse layout of an ML vector."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).alias("size"),
        F.col("tfidf.indices").alias("indices"),
        F.col("tfidf.weights").alias("values"),
    )


@dataclass(frozen=True)
class TextModel:
    """Vocabulary, coefficients and intercept; everything is bounded by the vocabulary."""

    tfidf: tfidf.TfIdf
    coefficients: tuple[float, ...]
    intercept: float
    trained_at: str
    classifier: str = "LogisticRegression"
    schema_version: str = SCHEMA_VERSION
    options: TextOptions = TextOptions()
    train_metrics: dict[str, float] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.classifier}_text_v{self.schema_version}_{self.trained_at}"

    @property
    def vocab_size(self) -> int:
        return len(self.tfidf.terms)

    @property
    def vectorizer_params(self) -> dict[str, object]:
        p = self.tfidf.params
        return {
            "max_features": p.max_features,
            "ngram_range": (p.ngram_min, p.ngram_max),
            "sublinear_tf": p.sublinear_tf,
        }

    def _products(self, sparse: Column) -> Column:
        coef = F.from_json(F.lit(json.dumps(self.coefficients)), "array<double>")
        return F.zip_with(
            sparse["indices"], sparse["weights"], lambda i, w: F.get(coef, i) * w
        )

    def score(self, df: DataFrame, output: str = SCORE_TEXT) -> DataFrame:
        """Append the phishing probability; blank text scores 0."""
        keep = df.columns
        margin = F.aggregate(
            self._products(F.col("tfidf")), F.lit(self.intercept), lambda acc, p: acc + p
        )
        probability = F.when(text.is_blank(F.col("prepared_text")), 0.0).otherwise(
            1.0 / (1.0 + F.exp(-margin))
        )
        return self.tfidf.weigh(df).select(*keep, probability.alias(output))

    def scorer(self) -> Scorer:
        return Scorer(self.name, self.score)

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.tfidf.terms, self.tfidf.idf, self.coefficients))
        return spark.createDataFrame(rows, "term string, idf double, coefficient double")

    def top_tokens(self, spark: SparkSession, top_k: int = 20) -> DataFrame:
        """The terms that pull hardest towards either class, strongest first."""
        table = self.coefficient_table(spark)
        sides = []
        for name, order in (
            ("phishing", F.desc("coefficient")), ("legitimate", F.asc("coefficient"))
        ):
            top = table.orderBy(order, F.asc("term")).limit(top_k)
            sides.append(
                top.select(F.lit(name).alias("class"), "term", F.col("coefficient"))
            )
        return sides[0].unionByName(sides[1])

    def token_contrib(
        self, df: DataFrame, top_k: int = 10, key: str = "msg_id"
    ) -> DataFrame:
        """Per mail, the terms that add most to the phishing margin, ranked in the row."""
        names = F.from_json(F.lit(json.dumps(self.tfidf.terms)), "array<string>")
        items = F.zip_with(
            "tfidf.indices",
            self._products(F.col("tfidf")),
            lambda i, p: F.struct((-p).alias("key"), F.get(names, i).alias("term")),
        )
        best = F.slice(F.sort_array(F.filter(items, lambda t: t["key"] < 0)), 1, top_k)
        weighed = self.tfidf.weigh(df.select(key, "prepared_text"))
        return weighed.select(key, F.posexplode(best).alias("pos", "t")).select(
            key,
            (F.col("pos") + 1).alias("rank"),
            F.col("t.term").alias("term"),
            (-F.col("t.key")).alias("contribution"),
        )


def train_text(
    corpus: DataFrame,
    params: TextModelParams = TextModelParams(),
    options: TextOptions = TextOptions(),
) -> TextModel:
    """Fit TF-IDF and a class-balanced logistic regression on ``prepared_text``/``label``.

    Mails are cleaned once: their words are written to the work folder, then the weighted
    sparse rows. The optimiser reads those once per iteration, and after a lost executor they are read again instead of
    cleaning and weighting the mails anew.
    """
    spark = corpus.sparkSession
    corpus = tfidf.tokenized(corpus, ["label"])
    model = tfidf.fit(corpus, params)
    if not model.terms:
        raise RuntimeError("no term occurs in enough mails to form a vocabulary")
    path = work_folder(spark, "text-vectors")
    weighted = corpora.with_class_weight(corpus)
    model.weigh(weighted).select(
        F.col("label").cast("double").alias("label"), "weight",
        sparse_parts(len(model.terms)).alias("features"),
    ).write.parquet(path)
    # the stored layout is that of ML vectors, so they are read as such
    schema = T.StructType([
        T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()),
        T.StructField("features", VectorUDT()),
    ])
    vectors = spark.read.schema(schema).parquet(path).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        lr = LogisticRegression(
            maxIter=params.max_iter,
            regParam=params.reg_param(model.n_docs),
            elasticNetParam=params.elastic_net,
            tol=params.tol,
            weightCol="weight",
            # inputs are already normalised, and scaling would change the penalty
            standardization=False,
            family="binomial",
        )
        fitted = lr.fit(vectors)
    finally:
        vectors.unpersist()
    return TextModel(
        tfidf=model,
        coefficients=tuple(float(c) for c in fitted.coefficients.toArray()),
        intercept=float(fitted.intercept),
        trained_at=datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"),
        options=options,
    )

