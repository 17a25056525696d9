"""CSV files read by byte ranges: cells that span lines, and still many tasks a file.

Whether a line starts inside a quoted cell depends on everything before it. Spark's text
reader deals a file out in ranges of whole lines; a first pass finds for each range where it
would end up if it started outside of a quoted cell, and where if inside. Composing these
small functions in the order of ranges gives every range its true start, and a second
pass cuts the lines into records, each range on its own. A record over the edge of a range
comes out in pieces, which meet by the range it began in.

The first pass also tells each file's encoding and header, so no further one is needed.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailscreen.session import work_folder

# executors need not have this package installed: ship the kernels themselves
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD, SURPLUS, PIECE = 0, 1, 2

_SURVEY = (
    "file string, start long, length long, from_outside boolean, from_inside boolean, "
    "ends_outside boolean, ends_inside boolean, utf8 boolean, header binary"
)
_PARSED = "layout int, file string, start long, seam long, lost boolean, text string, cells array<string>"

_BOM = b"\xef\xbb\xbf"


class _Grammar:
    """Patterns of whole records for one separator.

    A quote opens a cell only as its first character; elsewhere in a plain cell it is text, as
    is what follows a closing quote. Line ends outside of quotes end a record, so text after the
    last whole record always ends inside of a quoted cell.
    """

    def __init__(self, sep: str):
        s = re.escape(sep)
        plain = rf"[^{s}\r\n]*+"
        quoted = rf'(?:[^"]++|"")*+"{plain}'
        cell = rf'(?:"{quoted}|(?!"){plain})'
        rest = rf"(?:{s}{cell})*+(?:\r\n?|\n)"
        self.sep, self.blank = sep, "".join(c for c in " \t\r\n" if c != sep)
        self.record = re.compile(f"{cell}{rest}".encode())
        self.records = re.compile(f"(?:{cell}{rest})*+".encode())
        self.remainder = re.compile(f"{quoted}{rest}".encode())

    def whole(self, data: bytes, inside: bool) -> tuple[int, int]:
        """Where the record ends that is open at the start, and where the last whole one does;
        (-1, -1) if the open record goes on."""
        first = 0
        if inside:
            found = self.remainder.match(data)
            if found is None:
                return -1, -1
            first = found.end()
        return first, self.records.match(data, first).end()

    def first_filled(self, data: bytes) -> bytes | None:
        """The first whole record that is not blank."""
        at = 0
        while found := self.record.match(data, at):
            if found.group().strip(self.blank.encode()):
                return found.group()
            at = found.end()
        return None

    def rows(self, text: str) -> list[list[str]]:
        """Cells of whole records without blank ones: no cell, or one of white space."""
        csv.field_size_limit(2**31 - 1)
        return [
            r for r in csv.reader(io.StringIO(text, newline=""), delimiter=self.sep)
            if r and (len(r) > 1 or not r[0] or r[0].strip(self.blank))
        ]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that lie in one range of one file."""
    keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("file_hash", "start")]
    new = (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for first, stop in zip(edges, edges[1:]):
        if stop > first:
            yield batch.slice(first, stop - first)


def _first(part: pa.RecordBatch, column: str):
    return part.column(column)[0].as_py()


def _data(part: pa.RecordBatch, starts_file: bool) -> bytes:
    data = b"\n".join([*part.column("value").to_pylist(), b""])
    return data.removeprefix(_BOM) if starts_file else data


def _surveyor(sep: str) -> Callable:
    """Kernel: a row for each range, with its ends from both starts."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _Grammar(sep)
        schema = pa.schema([
            ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
            *((c, pa.bool_()) for c in
              ("from_outside", "from_inside", "ends_outside", "ends_inside", "utf8")),
            ("header", pa.binary()),
        ])
        key, row, head = None, None, b""
        for batch in batches:
            for part in _runs(batch):
                here = (_first(part, "file_hash"), _first(part, "start"))
                data = _data(part, here != key and here[1] == 0)
                if here != key:
                    if row is not None:
                        yield pa.RecordBatch.from_pylist([row], schema=schema)
                    key, head = here, b""
                    row = {
                        "file": _first(part, "file"), "start": here[1],
                        "length": _first(part, "length"),
                        "from_outside": False, "from_inside": True,
                        "ends_outside": False, "ends_inside": False, "utf8": True, "header": None,
                    }
                if row["utf8"]:
                    try:
                        data.decode()
                    except UnicodeDecodeError:
                        row["utf8"] = False
                ends = {}
                for side in ("outside", "inside"):
                    inside = row[f"from_{side}"]
                    if inside not in ends:
                        ends[inside] = grammar.whole(data, inside)[1]
                    row[f"from_{side}"] = ends[inside] < len(data)
                    row[f"ends_{side}"] |= ends[inside] > 0
                if here[1] == 0 and row["header"] is None:
                    head += data
                    row["header"] = grammar.first_filled(head)
        if row is not None:
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return survey


def _cutter(sep: str, encoding: str) -> Callable:
    """Kernel: the records of each range, and its pieces of records over an edge."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _Grammar(sep)
        types = {
            "layout": pa.int32(), "file": pa.string(), "start": pa.int64(), "seam": pa.int64(),
            "lost": pa.bool_(), "text": pa.string(), "cells": pa.list_(pa.string()),
        }
        key, info, codec = None, {}, encoding
        inside = entered = headed = False
        pending: list[bytes] = []  # of the open record

        def rows_of(n, **columns):
            columns = {c: [info[c]] * n for c in ("layout", "file", "start")} | columns
            return pa.RecordBatch.from_arrays(
                [pa.array(columns.get(c, [None] * n), t) for c, t in types.items()], list(types)
            )

        def piece(data, seam, lost=False):
            return rows_of(1, seam=[seam], lost=[lost], text=[data.decode(codec)])

        def last_piece():
            seam = info["seam_out"]
            return piece(b"".join(pending), seam, seam == info["lost_seam"])

        for batch in batches:
            for part in _runs(batch):
                here = (_first(part, "file_hash"), _first(part, "start"))
                data = _data(part, here != key and here[1] == 0)
                if here != key:
                    if pending:
                        yield last_piece()
                        pending = []
                    key = here
                    info = {
                        c: _first(part, c) for c in part.schema.names
                        if c not in ("value", "file_hash")
                    }
                    codec = "latin-1" if info["latin"] else encoding
                    inside = entered = info["inside"]
                    headed = here[1] != 0
                first, end = grammar.whole(data, inside)
                if end < 0:
                    pending.append(data)
                    continue
                pending.append(data[:first])
                done = b"".join(pending)
                if entered and first:  # the end of a record that began in an earlier range
                    yield piece(done, info["seam_in"])
                    entered, done = False, b""
                rows = grammar.rows((done + data[first:end]).decode(codec))
                if rows and not headed:
                    headed = True
                    del rows[0]
                if rows:
                    yield rows_of(len(rows), lost=[False] * len(rows), cells=rows)
                inside = end < len(data)
                pending = [data[end:]] if inside else []
        if pending:
            yield last_piece()

    return cut


def _stitched(sep: str) -> Callable:
    """Kernel: cells of records whose pieces were put together."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = _Grammar(sep)
        for batch in batches:
            cells = [grammar.rows(t)[0] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("layout"), batch.column("file"),
                 pa.array(cells, pa.list_(pa.string()))],
                ["layout", "file", "cells"],
            )

    return cut


def lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """value, file, start, length: every line as bytes with its range."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(files).select(
        F.col("value").cast("binary").alias("value"),
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        meta["file_block_length"].alias("length"),
        F.xxhash64(meta["file_path"]).alias("file_hash"),
    )


@contextmanager
def fixed_ranges(spark: SparkSession) -> Iterator[None]:
    """Deal files out alike in both passes, even if executors come or go between them."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.unset(name)


def survey(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """One row a range, written: where it ends up from either start, encoding, header."""
    path = work_folder(spark, "csv-ranges")
    lines(spark, files).mapInArrow(_surveyor(sep), _SURVEY).write.parquet(path)
    return spark.read.schema(_SURVEY).parquet(path)


def placed(ranges: DataFrame) -> DataFrame:
    """Ranges with their true start, the record that is open at each edge, and whether a
    record of the file never closes.

    A range maps its start, outside or inside, to its end: it fixes the end, keeps the start
    or turns it. The start of a range is the last fixed end before it, turned as often as
    ranges in between turn it.
    """
    file = Window.partitionBy("file").orderBy("start")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    whole = file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fixes = F.col("from_outside") == F.col("from_inside")
    turns = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    counted = ranges.withColumn("turns", F.sum(turns).over(file))
    fixed = F.when(fixes, F.struct(F.col("from_outside").alias("end"), "turns"))
    last = F.last(fixed, ignorenulls=True).over(before)
    turned = F.coalesce(F.lag("turns").over(file), F.lit(0))
    started = (
        counted.withColumn("fixed", last).withColumn("turned", turned)
        .withColumn("inside", F.coalesce("fixed.end", F.lit(False)) != (
            F.pmod(F.col("turned") - F.coalesce("fixed.turns", F.lit(0)), F.lit(2)) == 1
        ))
        .withColumn("open", F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside")))
        .withColumn("ends", F.when(F.col("inside"), F.col("ends_inside")).otherwise(F.col("ends_outside")))
    )
    begun = F.when(F.col("open") & (~F.col("inside") | F.col("ends")), F.col("start"))
    return (
        started.withColumn("begun", begun)
        .withColumn("seam_in", F.last("begun", ignorenulls=True).over(before))
        .withColumn("seam_out", F.coalesce("begun", "seam_in"))
        .select(
            "file", "start", "length", "inside", "seam_in", "seam_out",
            F.last(F.when(F.col("open"), F.col("seam_out"))).over(whole).alias("lost_seam"),
            (~F.min("utf8").over(whole)).alias("latin"),
            F.first("header").over(whole).alias("header"),
        )
    )


def column_names(header: list[str]) -> list[str]:
    """Names of a header's cells: the place for an empty one, name and place for repeats."""
    folded = [c.lower() for c in header]
    return [
        f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c
        for i, c in enumerate(header)
    ]


def read(
    spark: SparkSession, files: list[str], encoding: str, sep: str, shape: Callable[[Column], Column]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows, set-aside rows (file, cells), and the files read as Latin-1; parsed once.

    `shape` turns a cell into what its column holds. Files meet by the names in their
    headers. Blank records are skipped. Set aside are records of more cells than their header,
    and a record whose quote is never closed, as it is, in a piece for each range it covers.
    """
    declared_utf8 = encoding.upper().replace("-", "") in ("UTF8", "UTF8SIG")
    codec = "utf-8" if declared_utf8 else encoding
    if "\n".encode(codec) != b"\n" or len(sep.encode()) != 1:
        raise ValueError(f"lines and cells cannot be told by their bytes: {encoding}, {sep!r}")
    grammar = _Grammar(sep)
    with fixed_ranges(spark):
        ranges = placed(survey(spark, files, sep))
        if not declared_utf8:
            ranges = ranges.withColumn("latin", F.lit(False))
        # one row a file: listing them keeps more on the driver than this does
        heads = ranges.filter("start = 0").select("file", "latin", "header").collect()
        layouts: dict[tuple, int] = {}
        columns: list[tuple] = []
        for r in heads:
            if r.header is None:
                raise ValueError(f"{r.file} has no header that ends in its first range")
            if (r.header, r.latin) in layouts:
                continue
            text = bytes(r.header).decode("latin-1" if r.latin else codec)
            names = tuple(column_names(grammar.rows(text)[0]))
            if names not in columns:
                columns.append(names)
            layouts[r.header, r.latin] = columns.index(names)
        known = spark.createDataFrame(
            [(bytes(h), latin, i) for (h, latin), i in layouts.items()],
            "header binary, latin boolean, layout int",
        )
        # as many rows as the reader has ranges, which the driver lists for every scan
        starts = ranges.join(F.broadcast(known), ["header", "latin"]).drop("header")
        starts = starts.withColumn("known", F.lit(True))
        found = lines(spark, files).join(F.broadcast(starts), ["file", "start", "length"], "left")
        moved = F.raise_error(F.lit("the ranges of the files changed while they were read"))
        found = found.withColumn("layout", F.when(F.col("known"), F.col("layout")).otherwise(moved))
        parsed = found.drop("known").mapInArrow(_cutter(sep, codec), _PARSED)
        table = _landed(spark, parsed, columns, shape)

    joined = (
        table.filter(f"kind = {PIECE}").groupBy("layout", "file", "seam")
        .agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("pieces"))
        .select("layout", "file", F.array_join("pieces.text", "").alias("text"))
        .mapInArrow(_stitched(sep), "layout int, file string, cells array<string>")
    )
    over_edges = _shaped(joined, columns, shape)
    good = [t.filter(f"kind = {RECORD}").select("row.*") for t in (table, over_edges)]
    aside = [t.filter(f"kind = {SURPLUS}").select("file", "cells") for t in (table, over_edges)]
    return good[0].union(good[1]), aside[0].union(aside[1]), [r.file for r in heads if r.latin]


def _shaped(parsed: DataFrame, columns: list[tuple], shape: Callable[[Column], Column]) -> DataFrame:
    """kind, file, cells of set-aside records, row: cells by the union of all headers."""
    every = list(dict.fromkeys(name for names in columns for name in names))
    if not every:
        every = ["_c0"]

    def by_layout(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("layout"))

    width = by_layout([len(names) for names in columns] or [0])
    row = F.struct(*(
        shape(F.get("cells", by_layout(
            [names.index(c) if c in names else -1 for names in columns] or [-1]
        ))).alias(c)
        for c in every
    ))
    surplus = F.size("cells") > width
    return parsed.withColumns({
        "kind": F.when(surplus, SURPLUS).otherwise(RECORD),
        "row": F.when(~surplus, row),
        "cells": F.when(surplus, F.col("cells")),
    })


def _landed(
    spark: SparkSession, parsed: DataFrame, columns: list[tuple], shape: Callable[[Column], Column]
) -> DataFrame:
    rows = _shaped(parsed, columns, shape).withColumns({
        "kind": F.when(F.col("lost"), SURPLUS).when(F.col("seam").isNotNull(), PIECE)
        .otherwise(F.col("kind")),
        "cells": F.when(F.col("lost"), F.array("text")).otherwise(F.col("cells")),
    }).drop("lost")
    path = work_folder(spark, "csv-rows")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
