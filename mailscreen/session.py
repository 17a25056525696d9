"""Session helpers: settings worth having, a shared work folder, input spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the jobs are written for. Adaptive execution sizes shuffle partitions and
# splits skewed join partitions at run time; the Arrow cap bounds what one Python
# worker holds, since a single mail may carry 100,000 characters.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    # call-site capture triples the driver's cost of building column expressions
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path for written intermediates, in the shared folder the session names.

    That is `spark.checkpoint.dir`. Without it only a session on one machine (tests, bench)
    can go on, in a folder of its own there; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"mailscreen-{context.applicationId}")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def too_few_partitions(df: DataFrame) -> bool:
    """Whether the splits of a plain scan would leave cores idle.

    Only for scans: counting the partitions of a frame with shuffles would run them.
    """
    return df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """Give a small scanned table enough partitions to occupy every core.

    Text work is CPU-bound, and a table of one file and row group would run in one
    task. Inputs that already have at least as many partitions as cores - anything
    large - come back unchanged, so no shuffle is added at scale.
    """
    if not too_few_partitions(df):
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def settled(df: DataFrame, stage: str) -> DataFrame:
    """Count the rows of a stage and fix it as one the optimiser will not reorder.

    A filter on a computed column is normally moved below the projection computing it,
    by copying the expression into the filter. For text pipelines that means cleaning
    every mail once more, or a filter of exponential size. Filters stop at an observed
    stage while unused columns are still pruned below it, and the row count is
    reported to query listeners.
    """
    return df.observe(f"{stage}-{uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))
