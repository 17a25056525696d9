"""Structured Streaming over mail tables, with the same expressions as the batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailscreen.operators.corpus import content_hash
from mailscreen.operators.scoring import HEURISTIC_META, HEURISTIC_TEXT, Scorer
from mailscreen.params import ScreenParams, TextOptions
from mailscreen.plans import screen
from mailscreen.session import work_folder


def read_mails(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    glob: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as an unbounded table, read as they are split."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def stream_classify(
    mails: DataFrame,
    params: ScreenParams = ScreenParams(),
    meta_scorer: Scorer = HEURISTIC_META,
    text_scorer: Scorer = HEURISTIC_TEXT,
    options: TextOptions = TextOptions(),
    keep: list[str] | None = None,
) -> DataFrame:
    """Prediction records of a stream; stateless, so nothing is shuffled or kept."""
    return screen.classify(mails, params, meta_scorer, text_scorer, options, keep)


FIRST = ["content_hash", "slot"]


def first_values() -> list[Column]:
    """What is kept of a hash in a slot; values of several batches merge."""
    return [F.min("first").alias("first"), F.max("last_ts").alias("last_ts")]


def stream_dedup(
    mails: DataFrame,
    event_time: str = "event_ts",
    horizon: str = "2 days",
    delay: str | None = "2 days",
    key: str = "msg_id",
) -> DataFrame:
    """First mail and last time of every content hash, per slot as long as the horizon.

    ``first_mails`` tells from these rows which mails are no copies, whatever batches they
    came in. Keyed state holds one narrow row per hash and slot, no bodies; copies combine
    before the shuffle. Slots that ended more than ``delay`` before the newest mail leave
    the state, and mails that arrive later still are ignored; without a delay none are.
    """
    hashed = mails.select(
        event_time, F.col(key), content_hash(F.col("subject"), F.col("body")).alias("content_hash")
    )
    if delay is not None:
        hashed = hashed.withWatermark(event_time, delay)
    return (
        hashed.groupBy("content_hash", F.window(event_time, horizon).alias("w"))
        .agg(
            F.min(F.struct(F.col(event_time).alias("ts"), F.col(key).alias("id"))).alias("first"),
            F.max(event_time).alias("last_ts"),
        )
        .select("content_hash", F.col("w.start").alias("slot"), "first", "last_ts")
    )


def first_mails(slots: DataFrame, horizon: str = "2 days", key: str = "msg_id") -> DataFrame:
    """content_hash, event_ts and key of every mail that is no copy.

    A mail is a copy if one with its hash came before it (by time, then key) within the
    horizon. Such a mail stands in the same slot or at the end of the slot before, so
    first mail and last time of each slot decide.
    """
    before = slots.select(
        F.col("content_hash").alias("h"), (F.col("slot") + F.expr(f"INTERVAL {horizon}")).alias("s"),
        F.col("last_ts").alias("before_ts"),
    )
    same = (slots["content_hash"] == before["h"]) & (slots["slot"] == before["s"])
    near = F.col("before_ts") + F.expr(f"INTERVAL {horizon}") >= F.col("first.ts")
    return (
        slots.join(before, same, "left").filter(~F.coalesce(near, F.lit(False)))
        .select("content_hash", F.col("first.ts").alias("event_ts"), F.col("first.id").alias(key))
    )


def label_events(
    predictions: DataFrame, event_time: str = "event_ts", window: str = "1 hour"
) -> DataFrame:
    """One row per prediction with what it is counted under; stateless.

    Merged by sum (see ``merged``), every mail counts once, however late, and the stream
    keeps no state.
    """
    return predictions.select(
        F.window(event_time, window).alias("w"), F.col("label_predicted").alias("label"),
        F.col("gating.activated").alias("gated"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "label", "gated", F.lit(1).cast("long").alias("n"),
    )


def stream_label_counts(
    predictions: DataFrame,
    event_time: str = "event_ts",
    window: str = "1 hour",
    delay: str = "1 day",
) -> DataFrame:
    """Predicted labels and gate decisions per tumbling window, as a stateful aggregate.

    Windows older than the delay leave the state, and mails that arrive later still are
    dropped. To count those too, merge ``label_events``.
    """
    return (
        predictions.withWatermark(event_time, delay).groupBy(
            F.window(event_time, window).alias("w"),
            F.col("label_predicted").alias("label"),
            F.col("gating.activated").alias("gated"),
        )
        .agg(F.count("*").alias("n"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
            "label", "gated", "n",
        )
    )


def drain(stream: DataFrame, purpose: str = "stream") -> DataFrame:
    """Process everything available into a Parquet sink and read it back.

    The file sink is exactly-once; its checkpoint lives in the shared work folder.
    """
    spark = stream.sparkSession
    path = work_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
