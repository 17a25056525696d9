"""Quality classifier by Bradley-Terry pairwise ranking.

The probability that document a is better than b is the logistic function of the
difference of their scores, and a score is linear in features of the text. Weights come
from preference pairs, a document labelled 1 over one labelled 0, by logistic loss on the
difference of their features: a logistic regression without intercept, trained by Spark.
The threshold is the quantile of training scores at the share of label 0, over all labelled
training rows, and scores are shifted and squashed so that this quantile becomes `cut`.

Only rows that are not held out are learnt from; held out are ids whose CRC-32 as text is
0 modulo 5. The sample that weights are fitted on is bounded by `sample` rows of each label,
the ones with the smallest hash of their id, and each row of the rarer kind meets `partners`
others. Label counts and the quantile know no sample.
Scores are computed for every document. Features are ratios of the text alone.

Defined results: null or empty texts are scored by their zero features, very long ones whole; null ids are not
held out and have no label; repeated rows are scored alike; if either label is missing
there is no pair, all weights are 0, and every score equals `cut`; without documents there are
no rows; further columns of either table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.llm.staging import written
from mailscreen.llm.text_stats import text_counts


@dataclass(frozen=True)
class RankParams:
    sample: int = 10_000
    partners: int = 8
    regularisation: float = 1e-3
    cut: float = 0.3
    seed: int = 11

# bins that a round of `at_rank` brings to the driver
_BINS = 4096


def features() -> Column:
    """Features of a row that has the counts of `text_counts`."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")

    def share(name: str, of: Column) -> Column:
        return F.least(F.col(name) / of, F.lit(1.0))

    return F.array(
        share("n_symbols", words), F.sqrt(share("n_symbols", words)),
        share("n_upper", words), share("n_exclaim", words),
        share("n_plain", words),
        share("n_repeat_words", words), F.sqrt(share("n_repeat_words", words)),
        share("n_same_next", words), F.sqrt(share("n_same_next", words)),
        share("n_unique", words), F.log1p(F.col("n_words").cast("double")) / 10,
        F.least(F.col("n_unique") / F.sqrt(words), F.lit(20.0)) / 20,
        share("n_dup_lines", lines), share("n_ended_lines", lines),
        F.least(F.col("word_chars") / words, F.lit(20.0)) / 20,
        (F.col("n_words") < 5).cast("double"),
    )


def held_out(doc_id: Column) -> Column:
    remainder = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", text_counts("text").alias("c")).select("doc_id", "c.*")
        .select("doc_id", features().alias("x"))
    )


def training_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, quality) of every labelled row that is not held out."""
    labelled = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.join(labelled.select("doc_id", "quality"), "doc_id")


def training_sample(joined: DataFrame, params: RankParams) -> DataFrame:
    """(quality, place, x): bounded, with places from 0 within each label."""
    draw = F.xxhash64("doc_id", F.lit(params.seed))
    chosen = None
    for value in (0, 1):
        some = joined.filter(F.col("quality") == value).orderBy(draw, "doc_id")
        some = some.limit(params.sample)
        chosen = some if chosen is None else chosen.union(some)
    chosen = written(chosen, "rank-sample")
    # at most `sample` rows in a window
    place = F.row_number().over(Window.partitionBy("quality").orderBy(draw, "doc_id")) - 1
    return chosen.select("quality", place.alias("place"), "x")


def label_counts(rows: DataFrame) -> dict[int, int]:
    return {r.quality: r["count"] for r in rows.groupBy("quality").count().collect()}


def fit(sample: DataFrame, params: RankParams) -> list[float]:
    """Weights; scores are weights * x."""
    n = label_counts(sample)
    if len(n) < 2:
        return []
    rare = min(n, key=n.get)
    few, many = sample.filter(F.col("quality") == rare), sample.filter(F.col("quality") != rare)
    met = few.select("place", F.col("x").alias("a"), F.explode(
        F.sequence(F.lit(0), F.lit(params.partners - 1))
    ).alias("k")).withColumn(
        "partner", F.pmod(F.xxhash64("place", "k", F.lit(params.seed)), F.lit(n[1 - rare]))
    )
    pairs = met.join(many.select(F.col("place").alias("partner"), F.col("x").alias("b")), "partner")
    # half of the pairs are turned round, so that both outcomes occur
    turned = F.col("k") % 2 == 1
    sign = F.when(turned, -1.0).otherwise(1.0)
    better = F.lit(1.0 if rare == 1 else 0.0)
    pairs = pairs.select(
        array_to_vector(F.zip_with("a", "b", lambda a, b: (a - b) * sign)).alias("features"),
        F.when(turned, 1 - better).otherwise(better).alias("label"),
    )
    model = LogisticRegression(
        fitIntercept=False, standardization=True, regParam=params.regularisation, maxIter=100
    ).fit(pairs)
    return [float(w) for w in model.coefficients]


def at_rank(scores: DataFrame, rank: int) -> float:
    """The value at a rank, from 1 on, of the written column `s`: exact, in bounded memory.

    Each round counts the values in equal bins and goes on in the one that holds the rank.
    """
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    while low < high:
        width = (high - low) / _BINS
        # a width of zero is that of neighbouring numbers
        place = F.col("s")
        if width > 0:
            place = F.least(F.floor((F.col("s") - low) / width), F.lit(_BINS - 1))
        bins = (
            scores.filter(F.col("s").between(low, high))
            .groupBy(place.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
            .orderBy("bin").collect()
        )
        for b in bins:
            if rank <= b.n:
                break
            rank -= b.n
        low, high = b.low, b.high
    return low


def threshold(joined: DataFrame, weights: list[float]) -> float:
    """Quantile of the scores of all training rows at the share of label 0 among them."""
    if not weights:
        return 0.0
    scores = written(joined.select("quality", _linear(weights).alias("s")), "rank-scores")
    return at_rank(scores, label_counts(scores)[0])


def _linear(weights: list[float]) -> Column:
    if not weights:
        return F.lit(0.0)
    return F.aggregate(
        F.zip_with("x", F.array(*map(F.lit, weights)), lambda x, w: x * w),
        F.lit(0.0), lambda a, b: a + b,
    )


def ranked(docs: DataFrame, labels: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = written(measured(docs), "rank-features")
    joined = training_rows(rows, labels)
    weights = fit(training_sample(joined, params), params)
    quantile = threshold(joined, weights)
    shift = F.log(F.lit(params.cut / (1 - params.cut)))
    score = 1 / (1 + F.exp(-(_linear(weights) - F.lit(quantile) + shift)))
    # the quantile itself counts as reached, whatever the last digit says
    reached = _linear(weights) >= F.lit(quantile)
    score = F.when(reached, F.greatest(score, F.lit(params.cut))).otherwise(
        F.least(score, F.lit(params.cut - 1e-12))
    )
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= params.cut).cast("int"))
