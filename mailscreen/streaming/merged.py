"""A table of merged aggregates that a stream adds to, batch by batch.

Every batch leaves one small delta under its number, aggregated by key; a batch that runs again
writes over its own delta. From time to time the deltas are merged into a new base, numbered
after the last batch it holds, and what it replaces is removed, so the number of folders is
bounded however long the stream runs. Readers merge the newest finished base with later deltas.
The aggregates have to be mergeable: sums, least and greatest values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from mailscreen.session import work_folder


@dataclass(frozen=True)
class MergedTable:
    path: str
    keys: Sequence[str]
    merge: Sequence[Column]
    every: int = 16  # batches between two bases

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """Numbers of finished folders of a kind."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.path}/{kind}/*/_SUCCESS")
        fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(pattern) or []
        return sorted(int(s.getPath().getParent().getName()) for s in found)

    def _remove(self, spark: SparkSession, kind: str, number: int) -> None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{number}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(folder, True)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*self.merge)

    def _parts(self, spark: SparkSession) -> tuple[int, list[str]]:
        """The number of the newest base, and the folders that hold the table."""
        bases, deltas = self._numbers(spark, "base"), self._numbers(spark, "delta")
        base = bases[-1] if bases else -1
        folders = [f"{self.path}/base/{base}"] if bases else []
        return base, folders + [f"{self.path}/delta/{n}" for n in deltas if n > base]

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; for ``foreachBatch``."""
        spark = rows.sparkSession
        delta = self._merged(rows)
        delta.write.mode("overwrite").parquet(f"{self.path}/delta/{batch}")
        if (batch + 1) % self.every == 0:
            self.compact(spark, delta, batch)

    def compact(self, spark: SparkSession, like: DataFrame, batch: int) -> None:
        base, folders = self._parts(spark)
        if base < batch:
            rows = spark.read.schema(like.schema).parquet(*folders)
            self._merged(rows).write.mode("overwrite").parquet(f"{self.path}/base/{batch}")
        for kind, last in (("delta", batch), ("base", batch - 1)):
            for number in self._numbers(spark, kind):
                if number <= last:
                    self._remove(spark, kind, number)

    def folders(self, spark: SparkSession) -> int:
        return len(self._numbers(spark, "base")) + len(self._numbers(spark, "delta"))

    def read(self, spark: SparkSession, like: DataFrame) -> DataFrame:
        """The table as of the last batch; ``like`` gives the columns if no batch came yet."""
        shape = self._merged(like.sparkSession.createDataFrame([], like.schema))
        _, folders = self._parts(spark)
        if not folders:
            return shape
        return self._merged(spark.read.schema(shape.schema).parquet(*folders))


def drain_merged(
    stream: DataFrame,
    keys: Sequence[str],
    merge: Sequence[Column],
    purpose: str = "stream",
    mode: str = "append",
    every: int = 16,
) -> tuple[MergedTable, DataFrame]:
    """Process everything available into a merged table; the table and its rows."""
    spark = stream.sparkSession
    table = MergedTable(work_folder(spark, purpose), keys, merge, every)
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(table.add)
        .option("checkpointLocation", f"{table.path}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table, table.read(spark, stream)
