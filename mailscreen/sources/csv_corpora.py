"""CSV corpora: tolerant reading with an encoding fallback, then unification."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.operators import corpus
from mailscreen.operators.corpus import SourceSpec
from mailscreen.sources import csv_ranges

log = logging.getLogger(__name__)


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files behind a path (file, directory or glob); empty if absent."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(pattern) or []:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [
            s.getPath().toString()
            for s in inner
            if s.isFile() and not s.getPath().getName().startswith(("_", "."))
        ]
    return found


def _plain_cell(cell: Column) -> Column:
    """A cell, or null if it is a usual spelling of a missing one."""
    return F.when(~cell.isin(*lx.MISSING_CELLS), cell)


def read_csv(
    spark: SparkSession, files: list[str], encoding: str = "UTF-8", sep: str = ","
) -> tuple[DataFrame, DataFrame]:
    """All-string rows of CSV files, and the malformed rows set aside as (file, cells).

    Every file is read by its own header and, where UTF-8 is declared, as Latin-1 if it is
    not UTF-8; columns meet by name. A row with more cells than its header is malformed; one
    with fewer is padded with nulls. The usual spellings of a missing cell become null. A
    file is read by as many tasks as it has ranges, though cells may span lines.
    """
    rows, malformed, latin = csv_ranges.read(spark, files, encoding, sep, _plain_cell)
    for name in latin:
        log.warning("%s is not valid UTF-8; reading it as Latin-1", name)
    return rows, malformed


def load_parts(
    spark: SparkSession, spec: SourceSpec, raw_dir: str
) -> tuple[DataFrame, DataFrame] | None:
    """One corpus as raw rows and set-aside rows, or None (with a log entry).

    None is for a corpus that is absent, or has a file that cannot be read to its end.
    """
    path = f"{raw_dir.rstrip('/')}/{spec.filename}"
    try:
        files = _files(spark, path)
        if not files:
            log.error("[%s] no such file: %s", spec.name, path)
            return None
        return read_csv(spark, files, spec.encoding, spec.sep)
    except (PySparkException, Py4JJavaError, ValueError) as error:  # the other corpora go on
        log.error("[%s] cannot read %s: %s", spec.name, path, error)
        return None


def load_source(spark: SparkSession, spec: SourceSpec, raw_dir: str) -> DataFrame | None:
    parts = load_parts(spark, spec, raw_dir)
    return None if parts is None else parts[0]


def build_unified(
    spark: SparkSession, raw_dir: str, names: list[str] | None = None,
    rejects: str | None = None,
) -> DataFrame:
    """Read, map, check, hash and concatenate the registered corpora (or a subset).

    Malformed rows are counted in the log for each source, and written below ``rejects``
    if that is given.
    """
    frames = {}
    for spec in corpus.select_sources(names):
        parts = load_parts(spark, spec, raw_dir)
        if parts is None:
            continue
        rows, malformed = parts
        frames[spec.name] = rows
        if rejects is not None:
            path = f"{rejects.rstrip('/')}/dataset_source={spec.name}"
            malformed.write.mode("overwrite").parquet(path)
            malformed = spark.read.schema(malformed.schema).parquet(path)
        n_rejected = malformed.count()
        if n_rejected:
            log.warning("[%s] %d malformed rows were set aside", spec.name, n_rejected)
    if not frames:
        raise RuntimeError(f"no source could be read from {raw_dir}")
    return corpus.unify_corpora(frames)
