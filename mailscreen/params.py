"""Job parameters, checked before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from mailscreen import lexicons as lx


def _unit_interval(name: str, value: float) -> None:
    if not math.isfinite(value) or not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be a finite number in [0, 1], got {value!r}")


def _at_least(name: str, value: float, low: float) -> None:
    if not value >= low:
        raise ValueError(f"{name} must be >= {low}, got {value!r}")


@dataclass(frozen=True)
class ScreenParams:
    """Thresholds of the screening decision and its explanation.

    A mail whose metadata score reaches ``gate_threshold`` is decided on that score
    alone; otherwise both scores are fused with weight ``alpha`` on the metadata side
    and compared with ``decision_threshold``.
    """

    gate_threshold: float = 0.70
    alpha: float = 0.60
    decision_threshold: float = 0.50
    explain: bool = True
    top_k: int = 10

    def __post_init__(self) -> None:
        _unit_interval("gate_threshold", self.gate_threshold)
        _unit_interval("alpha", self.alpha)
        _unit_interval("decision_threshold", self.decision_threshold)
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int):
            raise ValueError(f"top_k must be an integer, got {self.top_k!r}")
        if not 1 <= self.top_k <= 100:
            raise ValueError(f"top_k must be in 1..100, got {self.top_k}")
        if self.gate_threshold <= self.decision_threshold:
            raise ValueError(
                f"gate_threshold ({self.gate_threshold}) must exceed "
                f"decision_threshold ({self.decision_threshold})"
            )


@dataclass(frozen=True)
class TextOptions:
    """How mail text is cleaned and prepared for the text model."""

    fold_unicode: bool = True
    # characters of prepared text that are kept; None keeps all
    max_text_length: int | None = None
    separator: str = lx.TEXT_SEPARATOR
    include_subject: bool = True
    # The stock lexicon holds accented terms that folded text can never contain.
    fold_lexicon: bool = False


@dataclass(frozen=True)
class RequestLimits:
    """Longest accepted fields of a mail handed in for scoring, in characters."""

    subject: int = 1_000
    body: int = 100_000
    sender: int = 500


@dataclass(frozen=True)
class ForestParams:
    """Random-forest training. ``max_bins`` sets the split-candidate resolution."""

    num_trees: int = 100
    max_depth: int = 10
    min_leaf: int = 5
    # floor(sqrt(32)); Spark's own "sqrt" would round up to 6
    features_per_split: str = "5"
    max_bins: int = 256
    seed: int = 42
    oob_folds: int = 3
    # out-of-bag estimate: trees grown on one bag, and forests of bags fitted side by side
    trees_per_bag: int = 4
    fits_at_once: int = 4

    def __post_init__(self) -> None:
        _at_least("num_trees", self.num_trees, 1)
        _at_least("max_depth", self.max_depth, 1)
        # the nodes of the forest are held on the driver and sent to every task
        if self.max_depth > 15 or self.num_trees * 2**self.max_depth > 1 << 22:
            raise ValueError("at most 15 levels and 2^22 leaves, got "
                             f"{self.num_trees} trees of depth {self.max_depth}")
        _at_least("min_leaf", self.min_leaf, 1)
        _at_least("max_bins", self.max_bins, 2)
        _at_least("oob_folds", self.oob_folds, 2)
        _at_least("trees_per_bag", self.trees_per_bag, 1)
        _at_least("fits_at_once", self.fits_at_once, 1)


@dataclass(frozen=True)
class TextModelParams:
    """TF-IDF and logistic-regression training."""

    max_features: int = 10_000
    ngram_min: int = 1
    ngram_max: int = 2
    min_df: int = 2
    sublinear_tf: bool = True
    c: float = 1.0
    penalty: str = "l2"
    l1_ratio: float = 0.5
    max_iter: int = 1_000
    tol: float = 1e-5

    def __post_init__(self) -> None:
        _at_least("max_features", self.max_features, 1)
        if self.max_features > 1 << 20:  # the vocabulary is sent to every task
            raise ValueError(f"at most 2^20 features, got {self.max_features}")
        _at_least("ngram_min", self.ngram_min, 1)
        _at_least("ngram_max", self.ngram_max, self.ngram_min)
        _at_least("min_df", self.min_df, 1)
        _at_least("max_iter", self.max_iter, 1)
        if self.c <= 0:
            raise ValueError(f"c must be positive, got {self.c}")
        if self.penalty not in ("l1", "l2", "elasticnet", "none"):
            raise ValueError(f"unknown penalty {self.penalty!r}")
        _unit_interval("l1_ratio", self.l1_ratio)

    @property
    def elastic_net(self) -> float:
        return {"l1": 1.0, "elasticnet": self.l1_ratio}.get(self.penalty, 0.0)

    def reg_param(self, n_rows: int) -> float:
        """Spark minimises a mean loss, so inverse regularisation C becomes 1/(C*n)."""
        return 0.0 if self.penalty == "none" else 1.0 / (self.c * n_rows)


@dataclass(frozen=True)
class SplitParams:
    """Shares of the train and validation splits; the rest is test."""

    train: float = 0.70
    val: float = 0.15
    seed: str = "42"
    buckets: int = field(default=10_000)

    def __post_init__(self) -> None:
        _unit_interval("train", self.train)
        _unit_interval("val", self.val)
        if self.train + self.val > 1.0:
            raise ValueError("train and val shares exceed 1")

    @property
    def train_end(self) -> int:
        return round(self.train * self.buckets)

    @property
    def val_end(self) -> int:
        return round((self.train + self.val) * self.buckets)
