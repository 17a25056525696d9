"""Removal of repeated passages of lines by winnowing.

A passage is a run of consecutive lines with `min_words` words or more; lines without a
word are skipped over. A line is deleted if it lies in a passage that equals an earlier
one, earlier by (doc_id, text hash, line) and without overlap, so the first occurrence of
every passage stays.

Around every line stand two windows: the shortest run that ends with it and the shortest
run that starts with it and has `min_words` words. All windows inside a repeated passage
are repeated, and together they cover it: windows that end at its lines reach back,
windows that start at its lines reach forward, which extends a match both ways to the
whole passage. The smallest line hash of a window is its fingerprint, the same in every
copy. Windows whose fingerprint was selected in one place only are dropped; for the others
the position of the first equal window is found by an aggregate over 128-bit hashes of
the lines, and joined back. No pair of copies is ever formed: each window meets one row,
however often a passage occurs.

A window has at most `min_words` lines, so work per line is bounded.

Defined results: null text stays null, empty text stays empty; a document that loses every
line keeps its row with empty text; rows equal in doc_id and text are one document and
come back as often as they occur; null ids sort first; other columns pass through, and
columns named as an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.staging import WORD, bundle, text_or_empty, written


@dataclass(frozen=True)
class PassageParams:
    min_words: int = 50


def _count_down(n: Column) -> Column:
    """0 ... n-1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def line_table(text: Column) -> Column:
    """(line, words, h, g) of every line with a word; two hashes of its text."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x, i: F.struct(
            i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"),
            F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"),
        ),
    )
    return F.filter(lines, lambda x: x["words"] > 0)


def _shortest(counts: Column, least: int) -> Column:
    """How many leading counts add up to `least`; 0 if all together do not."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    return F.aggregate(
        counts, start,
        lambda a, x: F.when(a["words"] >= least, a).otherwise(
            F.struct((a["words"] + x).alias("words"), (a["lines"] + 1).alias("lines"))
        ),
        lambda a: F.when(a["words"] >= least, a["lines"]).otherwise(0),
    )


def _windows(words: Column, least: int) -> Column:
    """(first, n) of the shortest windows that end and that start at each line."""
    every = _count_down(F.size(words))

    def ending(i: Column) -> Column:
        reach = F.least(i + 1, F.lit(least))
        before = F.reverse(F.slice(words, i - reach + 2, reach))
        n = F.when(F.get(words, i) >= least, 1).otherwise(_shortest(before, least))
        return F.struct((i - n + 1).alias("first"), n.alias("n"))

    def starting(i: Column) -> Column:
        n = _shortest(F.slice(words, i + 1, least), least)
        return F.struct(i.alias("first"), n.alias("n"))

    # a line of `least` words is both of its windows at once
    short = F.filter(every, lambda i: F.get(words, i) < least)
    both = F.concat(F.transform(every, ending), F.transform(short, starting))
    return F.filter(both, lambda w: w["n"] > 0)


def passage_windows(docs: DataFrame, params: PassageParams) -> DataFrame:
    """doc_id, text_hash, first, n, fingerprint and the window's 128-bit key (k1, k2)."""
    rows = docs.select(
        "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"),
        line_table(text_or_empty()).alias("lines"),
    ).select(
        "doc_id", "text_hash",
        F.col("lines.words").alias("words"), F.col("lines.h").alias("h"),
        F.col("lines.g").alias("g"),
    ).select("*", _windows(F.col("words"), params.min_words).alias("windows"))

    def keyed(w: Column) -> Column:
        h, g = (F.slice(c, w["first"] + 1, w["n"]) for c in ("h", "g"))
        return F.struct(
            w["first"].alias("first"), w["n"].alias("n"), F.array_min(h).alias("fingerprint"),
            F.xxhash64(h).alias("k1"), F.xxhash64(g).alias("k2"),
        )

    return rows.select(
        "doc_id", "text_hash", F.explode(F.transform("windows", keyed)).alias("w")
    ).select("doc_id", "text_hash", "w.*")


def repeated_runs(docs: DataFrame, params: PassageParams = PassageParams()) -> DataFrame:
    """doc_id, text_hash, first, n of every window that equals an earlier one."""
    windows = written(passage_windows(docs, params), "lines-windows")
    place = F.xxhash64("doc_id", "text_hash", "first")
    # what windows are joined with is written first, so that both sides are dealt out for the
    # join alone and a fingerprint or key that stands in very many places can be split
    shared = written(
        windows.groupBy("fingerprint")
        .agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
        .filter("lo <> hi").select("fingerprint"),
        "lines-shared",
    )
    candidates = written(
        windows.join(shared, "fingerprint", "left_semi").drop("fingerprint"), "lines-candidates"
    )
    where = F.struct("doc_id", "text_hash", "first")
    origin = written(
        candidates.groupBy("k1", "k2")
        .agg(F.min(where).alias("origin"), F.max(where).alias("last"))
        .filter("origin <> last").select("k1", "k2", "origin"),
        "lines-origins",
    )
    here = F.struct("doc_id", "text_hash")
    there = F.struct("origin.doc_id", "origin.text_hash")
    apart = ~here.eqNullSafe(there) | (F.col("first") >= F.col("origin.first") + F.col("n"))
    return (
        candidates.join(origin, ["k1", "k2"]).filter(apart)
        .select("doc_id", "text_hash", "first", "n").distinct()
    )


def without_runs(text: Column, runs: Column) -> Column:
    """The text without the lines of the given runs over lines that have words."""
    lines = F.split(text, "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    at = F.transform(
        F.filter(numbered, lambda s: F.rlike(s["x"], F.lit(WORD))), lambda s: s["line"]
    )
    gone = F.flatten(F.transform(
        runs, lambda r: F.sequence(F.get(at, r["first"]), F.get(at, r["first"] + r["n"] - 1))
    ))
    kept = F.array_except(_count_down(F.size(lines)), gone)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, params: PassageParams = PassageParams()) -> DataFrame:
    """The documents without later copies of passages; adds n_deleted, the lines deleted."""
    runs = written(repeated_runs(docs, params), "lines-runs")
    by_doc = runs.groupBy(
        F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash")
    ).agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash"))
    rows = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), bundle(docs))
    deleted = F.flatten(F.transform(
        "runs", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)
    ))
    cut = F.col("runs").isNotNull()
    n_deleted = F.when(cut, F.size(F.array_distinct(deleted))).otherwise(0).cast("long")
    whole = F.col("document.text")
    text = F.when(cut, without_runs(whole, F.col("runs"))).otherwise(whole)
    return rows.join(by_doc, same, "left").select(
        *[
            text.alias(c) if c == "text" else F.col("document").getField(c).alias(c)
            for c in docs.columns if c != "n_deleted"
        ],
        n_deleted.alias("n_deleted"),
    )
