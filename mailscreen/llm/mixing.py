"""Mixing sources to target weights by fractional repetition.

Words are totalled per source, each source gets a target, and the quotient of target and
total is the source's repetition rate. Every document is emitted floor(rate) times, and
once more if a number drawn from a hash of its id is below the fraction. The draw depends
on nothing but the seed and the row, so reruns and retried tasks agree.

Targets: sources in code-point order (null last) have the weights of `weights`, repeating.
They share `share` of all words by weight, but no target exceeds `max_rate` times its
source's words; what is cut off is shared again by weight until no target is above. That
is the solution of sum(min(cap, level * weight)) = total, found here by raising the level:
every round is one aggregate over the table of sources and sends two numbers to the driver.

Defined results: null text has no words; null source is a source; null ids draw by their
text; rows repeated in the input draw alike and each is emitted; without words all rates
are 0 and nothing is taken; empty tables stay empty. Columns of the input that have the
name of an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen.llm.staging import small, text_or_empty, word_count, written

# Sources of at most so many rows are broadcast: below 20 MB at 100 bytes a source.
SMALL_SOURCES = 200_000


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    max_rate: int = 3
    seed: str = "mix"


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", word_count(text_or_empty()))


def _ranked(sources: DataFrame) -> DataFrame:
    """Number the sources from 0 in code-point order without one task seeing them all.

    Ranges of sources are numbered inside and shifted by the rows of earlier ranges.
    """
    order = F.col("source").asc_nulls_last()
    ranges = written(
        sources.repartitionByRange(order)
        .withColumn("range", F.spark_partition_id()),
        "mix-sources",
    )
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition
    before = before.select(
        "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return (
        ranges.withColumn("inside", inside)
        .join(F.broadcast(before), "range")
        .withColumn("rank", F.col("before") + F.col("inside") - 1)
        .drop("range", "before", "inside")
    )


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """One row per source: source_size, weight, target. `sizes` has source and size."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*[F.lit(w) for w in params.weights])
    weight = F.get(weights, (F.col("rank") % len(params.weights)).cast("int"))
    sources = written(
        _ranked(sources).withColumn("weight", weight).drop("rank"), "mix-weights"
    )
    cap = F.col("source_size") * params.max_rate
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(False)
    while total:
        free_weight, held = sources.agg(
            F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, cap))
        ).first()
        raised = (total - (held or 0)) / free_weight
        if raised == level:
            break
        level, capped = raised, cap < F.lit(raised) * F.col("weight")
    return sources.withColumn(
        "target", F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    )


def draw(seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the row's id."""
    key = F.coalesce(
        F.col("doc_id").cast("string"),
        F.concat(F.lit("text "), F.sha2(text_or_empty().cast("binary"), 256)),
    )
    digest = F.sha2(F.concat(F.lit(f"{seed} "), key).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def with_copies(
    docs: DataFrame, targets: DataFrame, params: MixParams = MixParams()
) -> DataFrame:
    """Add source_size, target, copies and taken to documents that have a size."""
    targets = small(targets.select("source", "source_size", "target"), SMALL_SOURCES)
    docs = docs.drop("source_size", "target", "copies", "taken")
    same = docs["source"].eqNullSafe(targets["source"])
    joined = docs.join(targets, same, "left").drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = (whole + F.when(draw(params.seed) < rate - whole, 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mixed corpus: every document as often as its draw says, copy numbered from 1."""
    # totals come from a narrow table, so that the text is read once more, not shuffled
    narrow = written(sized(docs.select("source", "text")).select("source", "size"), "mix-sizes")
    chosen = with_copies(sized(docs), source_targets(narrow, params), params)
    return (
        chosen.filter(F.col("copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    )


def mixed_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The decision for every document: doc_id, size, source_size, target, taken, copies."""
    keep = docs.select(
        "doc_id", "source",
        F.when(F.col("doc_id").isNull(), F.col("text")).alias("text"),
        word_count(text_or_empty()).alias("size"),
    )
    narrow = written(keep, "mix-documents")
    return with_copies(narrow, source_targets(narrow, params), params).drop("text")
