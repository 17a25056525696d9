"""Binary evaluation: confusion counts, derived metrics, exact ROC AUC, class report."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.session import work_folder


def _ratio(top: Column, bottom: Column) -> Column:
    """Division that yields 0 where nothing was counted."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def with_prediction(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("prediction", (F.col(score) >= threshold).cast("int"))


def confusion(df: DataFrame) -> DataFrame:
    """Counts of ``label`` against ``prediction``, both 0/1, in one row."""
    y, p = F.col("label"), F.col("prediction")
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def eval_binary(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    c = confusion(df).select(
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
    return c.select("precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def recall_gate(df: DataFrame, target: float = lx.RECALL_TARGET) -> DataFrame:
    """Recall against its target."""
    return eval_binary(df).select(
        "recall", F.lit(target).alias("target"), (F.col("recall") >= target).alias("passed")
    )


def class_report(df: DataFrame) -> DataFrame:
    """Per-class metrics with support, then accuracy, macro and weighted averages.

    Only classes that occur among the labels are reported. The data is read once, for
    the confusion counts; the report is arithmetic on that single row.
    """
    measures = ("precision", "recall", "f1")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def entry(name: str, hits: Column, predicted: Column, support: Column) -> Column:
        p, r = _ratio(hits, predicted), _ratio(hits, support)
        return F.struct(
            F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
            _f1(p, r).alias("f1"), support.alias("support"),
        )

    classes = F.filter(
        F.array(
            entry("legitimate", tn, tn + fn, tn + fp), entry("phishing", tp, tp + fp, tp + fn)
        ),
        lambda c: c["support"] > 0,
    )
    total, hits = F.col("total"), tp + tn

    def over_classes(name: str, value) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *(value(m).alias(m) for m in measures),
            total.alias("support"),
        )

    def summed(term) -> Column:
        return F.aggregate("classes", F.lit(0.0), lambda acc, c: acc + term(c))

    summary = F.array(
        over_classes("accuracy", lambda m: _ratio(hits, total)),
        over_classes("macro avg", lambda m: summed(lambda c: c[m]) / F.size("classes")),
        over_classes(
            "weighted avg", lambda m: _ratio(summed(lambda c: c[m] * c["support"]), total)
        ),
    )
    counted = confusion(df).select(
        "*", classes.alias("classes"), (tp + fp + fn + tn).alias("total")
    )
    return (
        counted.filter("total > 0")
        .select(F.explode(F.concat("classes", summary)).alias("entry")).select("entry.*")
    )


def roc_auc(df: DataFrame, score: str, buckets: int = 512) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half, NaN with one class.

    Rows first collapse to one row per distinct score, map-side, which also absorbs
    any score shared by a large part of the data. That table is written out, so the
    scores are computed once. It is then cut into ranges at quantiles of the distinct
    scores: range totals are a small table that gets the global running sum, and the
    order inside each range is ranked range by range.
    """
    path = work_folder(df.sparkSession, "score-counts")
    (
        df.filter(F.col("label").isNotNull() & F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(
            F.count_if(F.col("label") == 1).alias("pos"),
            F.count_if(F.col("label") == 0).alias("neg"),
        )
        .write.parquet(path)
    )
    per_score = df.sparkSession.read.parquet(path)
    cuts = per_score.agg(
        F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10 * buckets)
    ).first()[0]
    splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.5)
    ranged = Bucketizer(splits=splits, inputCol="s", outputCol="range").transform(per_score)

    totals = ranged.groupBy("range").agg(
        F.sum("pos").alias("range_pos"), F.sum("neg").alias("range_neg")
    )
    lower = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range", F.coalesce(F.sum("range_neg").over(lower), F.lit(0)).alias("neg_below")
    )
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wins = (
        ranged.join(F.broadcast(offsets), "range")
        .withColumn(
            "below", F.col("neg_below") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
        )
        .agg(
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"),
            F.sum("pos").alias("p"),
            F.sum("neg").alias("n"),
        )
    )
    defined = (F.col("p") > 0) & (F.col("n") > 0)
    return wins.select(
        F.coalesce(F.col("p"), F.lit(0)).alias("n_positive"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n_negative"),
        F.when(defined, F.col("wins") / (F.col("p") * F.col("n")))
        .otherwise(F.lit(float("nan"))).alias("roc_auc"),
    )


def smoke_scores(df: DataFrame, score: str) -> DataFrame:
    """Range check of a score column: all finite and inside [0, 1]."""
    s = F.col(score)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.round(F.min(s), 6).alias("min_score"),
        F.round(F.max(s), 6).alias("max_score"),
        F.coalesce(F.bool_and(s.between(0.0, 1.0) & ~F.isnan(s)), F.lit(False)).alias("valid"),
    )
