"""Benchmark decontamination by winnowing.

Words are maximal runs of digits, letters a to z and characters beyond ASCII, after A to Z
are lower-cased. Item windows are `span` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. Every run of `span` words has `span - gram + 1`
k-grams, and the smallest of their hashes is the run's fingerprint. Equal runs have equal
fingerprints wherever they stand, so a shared run cannot be missed; runs of a document
whose fingerprint no benchmark window has are discarded inside the row. Runs that remain
are joined with the windows on their exact words, which rules out hash collisions, and
overlapping runs of one document extend each other to the whole shared passage.

What keeps the plan narrow: documents are scanned once and nothing but hits leaves the
row. The test against all fingerprints is a bit table of bounded size built by Spark and
held as a constant; a false positive costs one row in the exact join.

Defined results: null or empty texts have no words and no hits, very long ones are searched
whole; rows equal in doc_id and
text are counted as often as they occur; items without words match nothing; equal items
are all reported; null item ids are reported as the empty string; without items nothing
is hit. Further columns of either table are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.staging import ascii_lower, same_rows, small, text_or_empty, written

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Windows of at most so many rows are broadcast: some 30 MB at 10 words a window.
SMALL_WINDOWS = 250_000


@dataclass(frozen=True)
class SpanParams:
    span: int = 10
    gram: int = 5
    # the bit table has 16 bits a fingerprint, between these powers of two
    least_bits: int = 16
    most_bits: int = 24


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(c), BETWEEN_WORDS), "")


def _upto(last: Column) -> Column:
    """0, 1, ... last; empty if last is negative."""
    none = F.array().cast("array<int>")
    return F.when(last < 0, none).otherwise(F.sequence(F.lit(0), F.greatest(last, F.lit(0))))


def gram_hashes(words: Column, gram: int) -> Column:
    return F.transform(
        _upto(F.size(words) - gram),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]),
    )


def _smallest(hashes: Column, first: Column, n: int) -> Column:
    """Smallest of the n hashes from a position on."""
    if n == 1:
        return F.get(hashes, first)
    return F.array_min(F.slice(hashes, first + 1, n))


def _grams_for(length: int, params: SpanParams) -> int:
    return min(params.gram, length)


def _phrase(words: Column, first: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first + 1, length), " ")


def benchmark_windows(benchmark: DataFrame, params: SpanParams) -> DataFrame:
    """item, length, window: every window of every item, each once per item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        words_of(text_or_empty()).alias("words"),
    ).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(params.span))
    starts = items.select("item", "words", length.alias("length")).select(
        "item", "length",
        F.explode(
            F.transform(
                _upto(F.size("words") - F.col("length")),
                lambda i: _phrase(F.col("words"), i, F.col("length")),
            )
        ).alias("window"),
    )
    return starts.distinct()


def _fingerprint_of_window(length: int, params: SpanParams) -> Column:
    gram = _grams_for(length, params)
    hashes = gram_hashes(F.split("window", " "), gram)
    return _smallest(hashes, F.lit(0), length - gram + 1)


def _cell(h: Column, cells: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(cells - 1)).cast("int")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def bit_table(windows: DataFrame, length: int, params: SpanParams) -> Column | None:
    """Fingerprints of the windows of one length as a constant array of 64-bit cells.

    At most 2^most_bits bits, whatever the benchmark's size, reach the driver.
    """
    prints = windows.filter(F.col("length") == length).select(
        _fingerprint_of_window(length, params).alias("h")
    ).distinct()
    n = prints.count()
    if n == 0:
        return None
    bits = min(params.most_bits, max(params.least_bits, (16 * n - 1).bit_length()))
    cells = 1 << (bits - 6)
    rows = (
        prints.groupBy(_cell(F.col("h"), cells).alias("cell"))
        .agg(F.bit_or(_bit(F.col("h"))).alias("bits"))
        .collect()
    )
    table = ["0"] * cells
    for row in rows:
        table[row.cell] = str(row.bits)
    # one text constant, folded once into an array
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def _candidates(words: Column, hashes: dict, length: int, table: Column, params) -> Column:
    gram = _grams_for(length, params)
    grams = hashes[gram]
    cells = F.size(table)

    def listed(i: Column) -> Column:
        h = _smallest(grams, i, length - gram + 1)
        cell = F.shiftrightunsigned(h, 6).bitwiseAND((cells - 1).cast("long")).cast("int")
        return F.get(table, cell).bitwiseAND(_bit(h)) != 0

    return F.transform(
        F.filter(_upto(F.size(words) - length), listed),
        lambda i: F.struct(
            i.alias("first"), F.lit(length).alias("length"),
            _phrase(words, i, length).alias("window"),
        ),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, params: SpanParams = SpanParams()
) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated,
    and spans, the hit runs as (first, length) in words."""
    pairs = written(benchmark_windows(benchmark, params), "spans-items")
    lengths = sorted(r.length for r in pairs.select("length").distinct().collect())
    tables = {n: bit_table(pairs, n, params) for n in lengths}  # at most `span` lengths

    kinds = sorted({_grams_for(n, params) for n in lengths})
    text = text_or_empty()
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("text_hash"), words_of(text).alias("words")
    ).select(
        "*", *[gram_hashes(F.col("words"), g).alias(f"grams{g}") for g in kinds]
    )
    hashes = {g: F.col(f"grams{g}") for g in kinds}
    found = [_candidates(F.col("words"), hashes, n, tables[n], params) for n in lengths]
    empty = F.array().cast("array<struct<first:int,length:int,window:string>>")
    rows = rows.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
        F.posexplode_outer(F.concat(empty, *found)).alias("place", "candidate"),
    ).select("doc_id", "text_hash", "n_words", "place", "candidate.*")

    # rows without a candidate get a key of their own that no window has
    own = F.concat(F.lit("\u0000"), F.col("text_hash").cast("string"))
    rows = rows.withColumn("window", F.coalesce("window", own))
    windows = small(pairs.select("window").distinct().withColumn("hit", F.lit(True)), SMALL_WINDOWS)
    rows = rows.join(windows, "window", "left")
    hits = written(
        rows.select(
            "doc_id", "text_hash", "n_words", "place", "first", "length",
            F.when(F.col("hit"), F.col("window")).alias("window"),
        ),
        "spans-hits",
    )

    key = ("doc_id", "text_hash")
    cover = hits.groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.coalesce("place", F.lit(0)) == 0, 1).otherwise(0)).alias("rows"),
        F.collect_set(
            F.when(F.col("window").isNotNull(), F.struct("first", "length"))
        ).alias("runs"),
    )
    items = (
        hits.filter(F.col("window").isNotNull()).select(*key, "window").distinct()
        .join(small(pairs.select("window", "item"), SMALL_WINDOWS), "window")
        .select(*key, "item").distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    hit_words = F.aggregate(
        F.array_sort("runs"), start,
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["first"] + x["length"]).alias("upto"),
            (a["n"] + F.greatest(
                F.lit(0), x["first"] + x["length"] - F.greatest(a["upto"], x["first"])
            )).alias("n"),
        ),
        lambda a: a["n"],
    )
    # documents with hits are fewer than documents; both sides are narrow
    joined = cover.join(items, same_rows(cover, items, *key), "left").select(
        *[cover[k] for k in key], "n_words", "rows", "runs",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return joined.select(
        "doc_id", "text_hash", "n_words", hit_words.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        F.array_sort("runs").alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("occurrence"),
    ).drop("occurrence")


def clean(
    docs: DataFrame, benchmark: DataFrame, params: SpanParams = SpanParams()
) -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark."""
    dirty = contamination(docs, benchmark, params).filter("contaminated")
    dirty = written(
        dirty.select(F.col("doc_id").alias("dirty_id"), F.col("text_hash").alias("dirty_hash"))
        .distinct(),
        "spans-dirty",
    )
    dirty = small(dirty, SMALL_WINDOWS)
    same = docs["doc_id"].eqNullSafe(dirty["dirty_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dirty["dirty_hash"]
    )
    return docs.join(dirty, same, "left_anti")
