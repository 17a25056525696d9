"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule votes for good, for bad, or abstains. A document is good or bad in one of a few
kinds, unseen; given that, rules vote independently, each with its own rates.
Expectation-maximisation finds the rates and the share of each class from the votes alone,
and a document's posterior probability of being good decides, where all-must-pass
filtering would let every rule reject by itself. Kinds are needed because a shouting
document does not repeat itself: with one class for all that is bad, the good votes of the
rules that look for something else would clear it. Every kind is seen by several rules, so
that a single vote does not make one.

The votes of a document are one of at most 3^rules patterns. Spark counts the patterns,
and the iteration runs on that bounded table on the driver, over the votes of all
documents. Rates have weak priors that say rules are right more often than not, which
also fixes which side is the good one and gives a defined result for empty tables.

Defined results: null or empty texts have no words and fail the base rule; very long texts
are counted whole; repeated rows
count as often as they occur; other columns pass through and null ids are ids like any
other. Columns named as an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.staging import bundle, written
from mailscreen.llm.text_stats import text_counts

GOOD, ABSTAIN, BAD = 1, 0, -1


@dataclass(frozen=True)
class VoteParams:
    keep_from: float = 0.5
    rounds: int = 200
    tolerance: float = 1e-9
    # prior: votes of this many imagined documents of each class and rule
    prior_weight: float = 20.0


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, good_upto: float, bad_from: float) -> Column:
    """Good up to one bound, bad from another; the bounds may run either way."""
    if good_upto < bad_from:
        good, bad = value <= good_upto, value >= bad_from
    else:
        good, bad = value >= good_upto, value <= bad_from
    vote = F.when(good, GOOD).when(bad, BAD).otherwise(ABSTAIN)
    return F.when(F.col("n_words") > 0, vote).otherwise(ABSTAIN).cast("int")


RULE_NAMES = (
    "symbols", "plain_words", "capitals", "exclamations", "repeats", "same_next", "distinct",
    "line_copies", "line_ends",
)


def rules() -> dict[str, Column]:
    """Votes by name; bounds are shares of words or lines."""
    return {
        "symbols": _vote(_share("n_symbols", "n_words"), 0.02, 0.10),
        "plain_words": _vote(_share("n_plain", "n_words"), 0.95, 0.80),
        "capitals": _vote(_share("n_upper", "n_words"), 0.10, 0.30),
        "exclamations": _vote(_share("n_exclaim", "n_words"), 0.05, 0.20),
        "repeats": _vote(_share("n_repeat_words", "n_words"), 0.15, 0.30),
        "same_next": _vote(_share("n_same_next", "n_words"), 0.03, 0.10),
        "distinct": _vote(
            F.col("n_unique") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))), 4.0, 2.5
        ),
        "line_copies": _vote(_share("n_dup_lines", "n_lines"), 0.15, 0.30),
        # lines of scripts without a sign for the end of a sentence do not count
        "line_ends": F.when(
            2 * F.col("n_open_lines") > F.col("n_lines"), F.lit(ABSTAIN)
        ).otherwise(_vote(
            F.col("n_ended_lines") / F.greatest(F.col("n_lines") - F.col("n_open_lines"), F.lit(1)),
            0.80, 0.50,
        )),
    }


# the kinds of bad documents, and the rules that see each of them
BAD_KINDS = {
    "marked up": ("symbols", "plain_words"),
    "shouting": ("capitals", "exclamations", "plain_words"),
    "repeating": ("repeats", "same_next", "distinct", "line_copies"),
    "listing": ("line_ends", "plain_words"),
}


def fit(patterns: np.ndarray, counts: np.ndarray, params: VoteParams) -> tuple:
    """(shares[class], rates[class, rule, vote]) from distinct vote patterns.

    Class 0 is good, the others are BAD_KINDS; votes are indexed bad, abstain, good.
    """
    prior = np.empty((1 + len(BAD_KINDS), len(RULE_NAMES), 3))
    prior[:] = [0.02, 0.08, 0.90]
    for k, seen_by in enumerate(BAD_KINDS.values(), start=1):
        for name in seen_by:
            prior[k, RULE_NAMES.index(name)] = [0.70, 0.10, 0.20]
    share_prior = np.array([0.8] + [0.2 / len(BAD_KINDS)] * len(BAD_KINDS))
    votes = np.stack([patterns == v for v in (BAD, ABSTAIN, GOOD)], axis=2).astype(float)
    shares, rates = share_prior, prior
    parts = class_posteriors(patterns, shares, rates)
    for _ in range(params.rounds):
        weight = parts * counts
        mass = np.einsum("cp,prv->crv", weight, votes) + prior * params.prior_weight
        rates = mass / mass.sum(axis=2, keepdims=True)
        shares = weight.sum(axis=1) + share_prior * 10
        shares = shares / shares.sum()
        before, parts = parts, class_posteriors(patterns, shares, rates)
        if parts.size == 0 or np.abs(parts - before).max() < params.tolerance:
            break
    return shares, rates


def class_posteriors(patterns: np.ndarray, shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """[class, pattern] probabilities."""
    rule = np.arange(patterns.shape[1])
    logs = np.log(shares)[:, None] + np.log(rates)[:, rule, patterns + 1].sum(axis=2)
    logs -= logs.max(axis=0, keepdims=True)
    weight = np.exp(logs)
    return weight / weight.sum(axis=0, keepdims=True)


def posterior(patterns: np.ndarray, shares: np.ndarray, rates: np.ndarray) -> np.ndarray:
    return class_posteriors(patterns, shares, rates)[0]


def measured(docs: DataFrame) -> DataFrame:
    """Add the counts, base_failed and the rules' votes as the array `votes`."""
    counted = docs.withColumn("counts", text_counts("text")).select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in _ADDED], "counts.*"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    by_name = rules()
    votes = F.array(*[by_name[name] for name in RULE_NAMES])
    return counted.withColumn("base_failed", failed).withColumn("votes", votes)


_ADDED = {
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ended_lines",
    "n_repeat_words", "n_same_next", "n_upper", "n_plain", "n_unique", "n_exclaim",
    "n_open_lines", "counts", "base_failed", "votes", "p_good", "kept",
}


def judged(rows: DataFrame, params: VoteParams = VoteParams()) -> DataFrame:
    """Add p_good and kept to a written frame of `measured` documents."""
    seen = rows.groupBy("votes").count().orderBy("votes").collect()  # at most 3^rules rows
    patterns = np.array([r.votes for r in seen], dtype=np.int64).reshape(-1, len(RULE_NAMES))
    counts = np.array([r["count"] for r in seen], dtype=float)
    shares, rates = fit(patterns, counts, params)
    # odds of each kind of bad against good: the shares', times one factor for each vote
    against = F.lit(0.0)
    for kind in range(1, len(shares)):
        total = F.lit(float(np.log(shares[kind] / shares[0])))
        for i in range(len(RULE_NAMES)):
            table = F.array(*[F.lit(float(x)) for x in np.log(rates[kind, i] / rates[0, i])])
            total = total + F.get(table, F.get("votes", F.lit(i)) + 1)
        against = against + F.exp(total)
    p_good = 1 / (1 + against)
    return rows.withColumn("p_good", p_good).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= params.keep_from)
    )


def quality(docs: DataFrame, params: VoteParams = VoteParams()) -> DataFrame:
    """doc_id, counts, base_failed, votes, p_good, kept of every document."""
    return judged(written(measured(docs.select("doc_id", "text")).drop("text"), "rules-votes"), params)


def keep_good(docs: DataFrame, params: VoteParams = VoteParams()) -> DataFrame:
    """The documents that are kept, with their own columns only.

    Texts are written once beside their votes and filtered on reading, so they are
    measured once and never shuffled.
    """
    voted = measured(docs.select("text", bundle(docs))).drop("text")
    voted = written(voted, "rules-documents")
    return judged(voted, params).filter("kept").select("document.*")
