"""Corpus unification: schema mapping, labels, hashing, de-duplication, splits, summaries."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.functions import text
from mailscreen.params import SplitParams

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SourceSpec:
    """Where a corpus lives and which of its columns mean what.

    Candidates are tried in order, ignoring case. ``single_class`` corpora hold only
    phishing: a file of theirs without any label column is labelled 1 throughout.
    ``parse`` replaces the column mapping by a function of the raw frame.
    """

    name: str
    filename: str
    subject: tuple[str, ...] = ("subject",)
    body: tuple[str, ...] = ("body", "message", "text", "content")
    label: tuple[str, ...] = ("label", "spam", "class")
    single_class: bool = False
    encoding: str = "UTF-8"
    sep: str = ","
    parse: Callable[[DataFrame], DataFrame] | None = None


# --- fixed values: the seven corpora and their candidate columns ---
SOURCES = (
    SourceSpec("CEAS_08", "CEAS_08.csv",
               body=("body", "message", "content"),
               label=("label", "spam", "class", "category")),
    SourceSpec("Enron", "Enron.csv",
               body=("message", "body", "text", "content"),
               label=("label", "spam", "class")),
    SourceSpec("Ling", "Ling.csv",
               body=("body", "message", "text", "content"),
               label=("label", "spam", "spamclass", "class")),
    SourceSpec("Nazario", "Nazario.csv",
               body=("body", "text", "message", "content", "urls"),
               label=("label", "class", "spam"), single_class=True),
    SourceSpec("Nigerian_Fraud", "Nigerian_Fraud.csv",
               body=("body", "text", "message", "content"),
               label=("label", "class", "spam"), single_class=True),
    SourceSpec("phishing_email", "phishing_email.csv",
               body=("body", "message", "text_combined", "text"),
               label=("label", "class", "spam")),
    SourceSpec("SpamAssasin", "SpamAssasin.csv",
               body=("body", "message", "text", "content"),
               label=("label", "spam", "v1", "class")),
)
# --- fixed values: column preference of a combined-text file without subject or body ---
COMBINED_BODY = ("text_combined", "text", "message", "body")


def select_sources(names: list[str] | None = None) -> list[SourceSpec]:
    """The registered corpora, or the named subset; unknown names are an error."""
    if names is None:
        return list(SOURCES)
    unknown = sorted(set(names) - {s.name for s in SOURCES})
    if unknown:
        raise ValueError(f"unknown sources {unknown}; known: {[s.name for s in SOURCES]}")
    return [s for s in SOURCES if s.name in names]


def source_spec(name: str) -> SourceSpec:
    return select_sources([name])[0]


# ---------------------------------------------------------------- mapping


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def pick_column(df: DataFrame, candidates: tuple[str, ...], default: str = "") -> Column:
    """First existing candidate as string, nulls replaced; the default if none exists."""
    found = find_column(df.columns, candidates)
    if found is None:
        log.warning("none of the columns %s exists; using %r", candidates, default)
        return F.lit(default)
    return F.coalesce(df[found].cast("string"), F.lit(default))


def label_coerce(raw: Column) -> Column:
    """Raw label spelling to 0/1; anything unknown becomes null."""
    key = F.lower(text.strip_ws(raw))
    return (
        F.when(key.isin(*lx.PHISHING_LABELS), 1)
        .when(key.isin(*lx.LEGITIMATE_LABELS), 0)
        .cast("tinyint")
    )


def unify_schema(
    df: DataFrame,
    source: str,
    subject: tuple[str, ...] = ("subject",),
    body: tuple[str, ...] = ("body",),
    label: tuple[str, ...] = ("label",),
    all_phishing: bool = False,
    all_legit: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Map any frame to source, subject, body and label, in one projection.

    A label that cannot be read stays null here and condemns its source later, in
    :func:`drop_bad_sources`. ``label_imputed`` marks labels that were missing and
    defaulted to 0. ``keep`` carries further columns through.
    """
    imputed: Column = F.lit(False)
    if all_phishing:
        value = F.lit(1).cast("tinyint")
    elif all_legit:
        value = F.lit(0).cast("tinyint")
    else:
        value = label_coerce(pick_column(df, label, "0"))
        found = find_column(df.columns, label)
        imputed = F.lit(True) if found is None else df[found].isNull()
    return df.select(
        *keep,
        F.lit(source).alias("dataset_source"),
        pick_column(df, subject).alias("subject"),
        pick_column(df, body).alias("body"),
        value.alias("label"),
        imputed.alias("label_imputed"),
    )


def unify_source(df: DataFrame, spec: SourceSpec, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply a corpus's own mapping to its raw frame."""
    if spec.parse is not None:
        return spec.parse(df)
    subject, body = spec.subject, spec.body
    if "text_combined" in body and find_column(df.columns, ("subject", "body", "message")) is None:
        body = COMBINED_BODY
    unlabelled = find_column(df.columns, spec.label) is None
    return unify_schema(
        df, spec.name, subject, body, spec.label,
        all_phishing=spec.single_class and unlabelled, keep=keep,
    )


def require_columns(df: DataFrame, required: tuple[str, ...], what: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the required columns {missing}")
    return df


def bad_sources(frames: list[DataFrame]) -> set[str]:
    """Names of the sources that hold an unreadable label.

    One aggregate over two narrow columns; one row per registered source comes back.
    """
    labels = union_all([df.select("dataset_source", "label") for df in frames])
    found = labels.groupBy("dataset_source").agg(F.bool_or(F.col("label").isNull()).alias("bad"))
    return {r.dataset_source for r in found.filter("bad").collect()}


def drop_bad_sources(df: DataFrame) -> DataFrame:
    """Drop every source that holds an unreadable label, from a table of many sources."""
    bad = bad_sources([df])
    return df.filter(~F.col("dataset_source").isin(*bad)) if bad else df


def filter_empty(df: DataFrame) -> DataFrame:
    """Keep rows with anything but white space in subject or body."""
    def blank(name: str) -> Column:
        return text.is_blank(F.coalesce(F.col(name), F.lit("")))

    return df.filter(~(blank("subject") & blank("body")))


def content_hash(subject: Column, body: Column) -> Column:
    """MD5 of both texts with a NUL between them, so that no shift of the cut collides."""
    return F.md5(
        F.concat(F.coalesce(subject, F.lit("")), F.lit("\x00"), F.coalesce(body, F.lit("")))
    )


def with_content_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", content_hash(F.col("subject"), F.col("body")))


def order_cast(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Final column order and types of the unified table."""
    require_columns(df, (*lx.UNIFIED_COLUMNS, "content_hash"), "the unified table")
    return df.select(
        *keep, "dataset_source", "subject", "body",
        F.col("label").cast("tinyint").alias("label"), "content_hash",
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenate sources by column name; duplicates stay."""
    if not frames:
        raise RuntimeError("no source could be processed")
    return reduce(lambda a, b: a.unionByName(b), frames)


def unify_corpora(
    frames: dict[str, DataFrame], keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw frames by source name to the unified, hashed table (duplicates included)."""
    mapped = [unify_source(df, source_spec(name), keep) for name, df in frames.items()]
    for m in mapped:
        require_columns(m, lx.UNIFIED_COLUMNS, "a parsed source")
    # decided before the union, so that a bad source is not read again
    bad = bad_sources(mapped)
    good = [m for m, name in zip(mapped, frames) if name not in bad]
    return order_cast(with_content_hash(filter_empty(union_all(good))), keep)


# ---------------------------------------------------------------- dedup and split


def source_priority(source: Column) -> Column:
    """Registry order; unregistered sources come last."""
    ranks = F.create_map(*(x for i, s in enumerate(SOURCES) for x in (F.lit(s.name), F.lit(i))))
    return F.coalesce(F.try_element_at(ranks, source), F.lit(len(SOURCES)))


def dedup_by_hash(df: DataFrame, tie: str = "msg_id") -> DataFrame:
    """One row per content hash: the best source, then the smallest ``tie`` value.

    An aggregate rather than a ranking window: each task first reduces its own copies,
    so a mail that makes up a third of the corpus reaches the shuffle as one row per
    task instead of landing in one sort. Subject and body stay out of the aggregate; where
    the frame has them, the winners fetch theirs by one semi-join. ``tie`` tells the
    copies of one source apart.
    """
    texts = [c for c in ("subject", "body") if c in df.columns]
    narrow = df.drop(*texts)
    columns = [c for c in narrow.columns if c != "content_hash"]
    order = F.struct(source_priority(F.col("dataset_source")), F.col(tie))
    best = narrow.groupBy("content_hash").agg(F.min_by(F.struct(*columns), order).alias("row"))
    best = best.select(*(F.col(f"row.{c}").alias(c) for c in columns), "content_hash")
    if not texts:
        return best.select(df.columns)
    won = best.select(
        F.col("content_hash").alias("_h"), F.col("dataset_source").alias("_s"), F.col(tie).alias("_t")
    )
    same = (
        (F.col("content_hash") == F.col("_h"))
        & F.col("dataset_source").eqNullSafe(F.col("_s")) & F.col(tie).eqNullSafe(F.col("_t"))
    )
    return df.join(won, same, "left_semi")


def split_bucket(content_hash_col: Column, params: SplitParams = SplitParams()) -> Column:
    """Stable bucket of a mail; depends on nothing but its hash and the seed."""
    salted = F.md5(F.concat(content_hash_col, F.lit(params.seed)))
    return F.conv(F.substring(salted, 1, 8), 16, 10).cast("bigint") % params.buckets


def stratified_split(df: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """Append ``split`` by hash bucket: no shuffle, stable when mails are appended.

    Every label gets its shares up to sampling noise, which vanishes with size. Meant
    for de-duplicated mails; copies of one mail always share a split.
    """
    bucket = split_bucket(F.col("content_hash"), params)
    return df.withColumn(
        "split",
        F.when(bucket < params.train_end, "train")
        .when(bucket < params.val_end, "val")
        .otherwise("test"),
    )


def stratified_split_exact(
    df: DataFrame, params: SplitParams = SplitParams(), key: str = "content_hash"
) -> DataFrame:
    """Append ``split`` with exact per-label quotas; ``key`` must be unique.

    Ranking a whole label would sort half the data in one task. Instead bucket counts
    (at most labels x buckets rows) place every bucket wholly inside a split, save the
    few buckets a quota cuts through, and only their rows are ranked.
    """
    label = F.coalesce(F.col("label").cast("int"), F.lit(-1))
    keyed = df.withColumn("_b", split_bucket(F.col(key), params)).withColumn("_l", label)
    running = Window.partitionBy("_l").orderBy("_b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    total = F.sum("_n").over(Window.partitionBy("_l"))
    counts = (
        keyed.groupBy("_l", "_b").agg(F.count("*").alias("_n"))
        .select("_l", "_b", "_n", F.sum("_n").over(running).alias("_upto"), total.alias("_all"))
        .select(
            "_l", "_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto",
            F.floor(F.col("_all") * params.train).alias("_train"),
            F.floor(F.col("_all") * (params.train + params.val)).alias("_val"),
        )
    )

    def place(rank_from: Column) -> Column:
        return (
            F.when(rank_from < F.col("_train"), "train")
            .when(rank_from < F.col("_val"), "val")
            .otherwise("test")
        )

    cut = (
        (F.col("_before") < F.col("_train")) & (F.col("_train") < F.col("_upto"))
    ) | ((F.col("_before") < F.col("_val")) & (F.col("_val") < F.col("_upto")))
    placed = keyed.join(F.broadcast(counts.withColumn("_cut", cut)), ["_l", "_b"])
    within = Window.partitionBy("_l", "_b").orderBy(key)
    whole = placed.filter(~F.col("_cut")).select(*df.columns, place(F.col("_before")).alias("split"))
    ranked = placed.filter("_cut").withColumn("_r", F.row_number().over(within) - 1)
    return whole.unionByName(
        ranked.select(*df.columns, place(F.col("_before") + F.col("_r")).alias("split"))
    )


# ---------------------------------------------------------------- summaries


def _share(n: Column, total: Column) -> Column:
    return F.round(n * 100.0 / F.nullif(total, F.lit(0)), 4)


def summary_total(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, label counts and shares, distinct and duplicate hashes, in one row."""
    distinct = (
        F.approx_count_distinct("content_hash", 0.01)
        if approximate
        else F.count_distinct("content_hash")
    )
    totals = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_phishing"),
        F.count_if(F.col("label") == 0).alias("n_legitimate"),
        distinct.alias("n_hashes"),
    )
    return totals.select(
        "n_rows", "n_phishing", "n_legitimate",
        _share(F.col("n_phishing"), F.col("n_rows")).alias("pct_phishing"),
        _share(F.col("n_legitimate"), F.col("n_rows")).alias("pct_legitimate"),
        "n_hashes", (F.col("n_rows") - F.col("n_hashes")).alias("n_duplicates"),
    )


def summary_by_source(df: DataFrame) -> DataFrame:
    """Rows and label counts per source; the row without a source is the grand total."""
    return df.rollup("dataset_source").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("label") == 1).alias("n_phishing"),
        F.count_if(F.col("label") == 0).alias("n_legitimate"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    """Label counts and shares per split."""
    per_label = df.groupBy("split", "label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))
    return per_label.select("split", "label", "n", _share(F.col("n"), total).alias("pct"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weight of every label: rows / (labels * rows with the label)."""
    per_label = df.groupBy("label").agg(F.count("*").alias("n"))
    everything = Window.partitionBy()  # one row per label, so a handful
    return per_label.select(
        "label", "n",
        (
            F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))
        ).alias("weight"),
    )


def with_class_weight(df: DataFrame, output: str = "weight") -> DataFrame:
    """Join the balanced weight to every row; the broadcast side has one row per label."""
    weights = class_weights(df).select("label", F.col("weight").alias(output))
    return df.join(F.broadcast(weights), "label").select(*df.columns, output)
