"""Path-dependent TreeSHAP for the metadata forest.

Every root-to-leaf path is an additive little game: the leaf value is reached if all
features on the path fall into their intervals. The Shapley values of such a game have
a closed form (an integral of a product of shares of training weight, a polynomial),
so a mail's values are a sum over paths. What a path adds depends on a mail only by which intervals it
falls into, so a table by pattern of intervals is worked out once, and mails look their
values up. Both tables depend on the model alone, are bounded, and are broadcast; mails are
processed batch-wise in a narrow Arrow stage.
"""

from __future__ import annotations

import itertools
import logging
import math
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen import lexicons as lx
from mailscreen.session import settled, work_folder

log = logging.getLogger(__name__)

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELLS = 200_000  # rows x paths looked up at once
_CELLS_WORKED_OUT = 20_000  # rows x paths worked out at once, in the processor's cache
# numbers in the pattern tables, 64 MB broadcast; paths beyond are worked out per mail
MOST_PATTERNS = 8_000_000
# numbers in the table of a bundle of paths, which should stay in the processor's cache
_BUNDLE = 1 << 15
# numbers in the table of what the paths of a stem do not share
_STEM = 400
_ROWS = 4_000  # rows whose patterns are looked up at once
_EVERYWHERE = (-math.inf, math.inf, 1.0)


# Paths with the same number of distinct features, as plain arrays so that they can be
# broadcast to workers without this package: feature, low, high and share are
# paths x depth (an interval is (low, high], share the training weight staying inside),
# value is the leaf's part of the forest's probability.
PathGroup = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
# A path's interval and share by feature, and its leaf's part of the forest's probability.
Bounds = tuple[float, float, float]
Path = tuple[dict[int, Bounds], float]
# Features, what the range between edges that a number of each falls into adds to a pattern
# (see Bundle.places), and numbers by pattern.
Table = tuple[list[int], list[np.ndarray], np.ndarray]
# What a bundle without a table is worked out from (see Bundle.stem): tables of the two halves
# of the features that all its paths share, with the ranges inside their intervals instead of
# places; the table of the others; weights of the Gauss points; slopes of the shared features.
Stem = tuple[list[Table], Table, np.ndarray, np.ndarray]
# Edges of all intervals by feature, and how the paths are looked up or worked out.
Plan = tuple[dict[int, np.ndarray], list[Table], list[Stem]]


def node_table(forest, spark: SparkSession) -> DataFrame:
    """The forest's nodes as a table, by way of its saved form."""
    path = work_folder(spark, "forest")
    forest.write().save(path)
    return spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")


def tree_paths(nodes: DataFrame, n_trees: int) -> tuple[list[list[Path]], float]:
    """Root-to-leaf paths by tree, neighbours beside each other, and the expected probability."""
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.select(
        "treeID", "id", "impurityStats", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ).collect():
        trees.setdefault(r.treeID, {})[r.id] = r
    if len(trees) != n_trees:
        raise ValueError(f"read {len(trees)} of {n_trees} trees")

    paths: list[list[Path]] = []
    expected = 0.0
    for tree in trees.values():
        paths.append([])
        stack = [(0, {})]
        while stack:
            node_id, held = stack.pop()
            node = tree[node_id]
            cover = sum(node.impurityStats)
            if node.leftChild < 0:
                value = node.impurityStats[1] / cover / n_trees
                expected += value * math.prod(s for _, _, s in held.values())
                if held:  # a single leaf explains nothing
                    paths[-1].append((held, value))
                continue
            low, high, share = held.get(node.feature, (-math.inf, math.inf, 1.0))
            for child, bounds in (
                (node.leftChild, (low, min(high, node.threshold))),
                (node.rightChild, (max(low, node.threshold), high)),
            ):
                kept = sum(tree[child].impurityStats) / cover
                if kept > 0:
                    stack.append((child, {**held, node.feature: (*bounds, share * kept)}))
    return paths, expected


def by_depth(paths: list[Path]) -> list[PathGroup]:
    """Paths as arrays, shallow ones first."""
    depths: dict[int, list[Path]] = {}
    for path in paths:
        depths.setdefault(len(path[0]), []).append(path)
    groups = []
    for _, alike in sorted(depths.items()):
        cells = np.array([[(f, *b) for f, b in held.items()] for held, _ in alike])
        groups.append(
            (
                cells[:, :, 0].astype(int), cells[:, :, 1], cells[:, :, 2], cells[:, :, 3],
                np.array([v for _, v in alike]),
            )
        )
    return groups


def path_groups(nodes: DataFrame, n_trees: int) -> tuple[list[PathGroup], float]:
    """Root-to-leaf paths of a forest and its expected probability."""
    paths, expected = tree_paths(nodes, n_trees)
    return by_depth([p for tree in paths for p in tree]), expected


@lru_cache
def _gauss(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights, as columns, that integrate polynomials of degree ``depth`` - 1 exactly."""
    points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    return (points[:, None] + 1) / 2, weights[:, None] / 2


def _factors(hit: list[np.ndarray], share: np.ndarray) -> Iterator[np.ndarray]:
    """The Shapley value of each of a path's features over its leaf value.

    ``hit[i]`` says where the interval of feature i holds, in any shape that ends in the
    paths; ``share`` is paths x depth.
    """
    depth = len(hit)
    # A feature's value is the integral over t from 0 to 1 of the product of the others'
    # factors, t where the interval holds and else 0, plus (1 - t) times the share: a polynomial
    # in t of degree depth - 1.
    totals = [np.zeros(h.shape) for h in hit]
    for t, weight in zip(*_gauss(depth)):
        # all factors are positive, so one can be divided out again
        outside = share * (1 - t)
        factors = [outside[:, i] + t * h for i, h in enumerate(hit)]
        product = np.full(hit[0].shape, weight)
        for factor in factors:
            product *= factor
        for total, factor in zip(totals, factors):
            total += product / factor
    for i in range(depth):
        yield (hit[i] - share[:, i]) * totals[i]


def pattern_table(group: PathGroup) -> np.ndarray:
    """Shapley values by place in the path, and pattern and path: depth x (2^depth * paths).

    What a path adds depends on a mail only by which of its intervals hold, a pattern of
    ``depth`` bits, so values are worked out once per path and pattern instead of per mail.
    """
    _, _, _, share, leaf = group
    n_paths, depth = share.shape
    patterns = np.arange(1 << depth)[:, None]
    hit = [np.broadcast_to((patterns >> i & 1).astype(bool), (1 << depth, n_paths)) for i in range(depth)]
    return np.stack([(leaf * f).ravel() for f in _factors(hit, share)])


def pattern_tables(groups: list[PathGroup], most: int = MOST_PATTERNS) -> list[np.ndarray | None]:
    """Tables of all groups that fit into ``most`` numbers, shallow paths first."""
    tables: list[np.ndarray | None] = []
    for group in groups:  # in order of depth
        n_paths, depth = group[0].shape
        most -= n_paths * depth << depth
        tables.append(pattern_table(group) if most >= 0 else None)
    return tables


def shap_values(
    x: np.ndarray, groups: list[PathGroup], tables: list[np.ndarray | None] | None = None
) -> np.ndarray:
    """Shapley values of every row of ``x``, one column per feature."""
    out = np.zeros(x.shape)
    for g, (feature, low, high, share, leaf) in enumerate(groups):
        n_paths, depth = feature.shape
        table = tables[g] if tables else None
        # paths in order of the feature at each place, and where each feature begins
        sums = []
        for i in range(depth):
            order = np.argsort(feature[:, i], kind="stable")
            sums.append((order, *np.unique(feature[order, i], return_index=True)))
        step = max(1, (_CELLS_WORKED_OUT if table is None else _CELLS) // n_paths)
        for start in range(0, len(x), step):
            rows = x[start : start + step]
            hit = []
            for i in range(depth):
                values = rows[:, feature[:, i]]
                hit.append((values > low[:, i]) & (values <= high[:, i]))
            if table is None:
                parts = (leaf * f for f in _factors(hit, share))
            else:
                cells = np.zeros(hit[0].shape, dtype=np.int64)
                for i in range(depth - 1, -1, -1):
                    cells += cells
                    cells += hit[i]
                cells *= n_paths
                cells += np.arange(n_paths)
                parts = (table[i].take(cells) for i in range(depth))
            for (order, columns, starts), part in zip(sums, parts):
                out[start : start + step, columns] += np.add.reduceat(part[:, order], starts, axis=1)
    return out


@lru_cache(maxsize=1 << 16)
def _classes(
    bounds: frozenset[Bounds],
) -> tuple[list[float], np.ndarray, dict[Bounds, tuple[bool, ...]], int]:
    """What a number can be to some intervals: their edges, the class of each range between
    these, for each interval the classes that fall into it, and the number of classes."""
    edges = sorted({b for low, high, _ in bounds for b in (low, high) if math.isfinite(b)})
    known: dict[tuple[bool, ...], int] = {}
    classes = [
        known.setdefault(tuple(low <= a and b <= high for low, high, _ in bounds), len(known))
        for a, b in itertools.pairwise([-math.inf, *edges, math.inf])
    ]
    return edges, np.array(classes), dict(zip(bounds, zip(*known))), len(known)


def _n_patterns(bounds: Iterable[frozenset[Bounds]]) -> int:
    return math.prod([_classes(b)[3] for b in bounds])


def _product(terms: list[np.ndarray], width: int) -> np.ndarray:
    """Products by pattern of classes, the last feature's running fastest, beside ``width`` others."""
    out = np.ones((1, width))
    for term in terms:
        out = (out[:, None] * term).reshape(-1, width)
    return out


def _gained(product: np.ndarray, gains: list[np.ndarray]) -> np.ndarray:
    """A product of factors with each in turn replaced by its gain, below each other."""
    after, width = product.shape
    out = [np.empty((0, width))]
    for gain in gains:
        after //= len(gain)
        out.append((product.reshape(-1, len(gain), after, width) * gain[:, None]).reshape(-1, width))
    return np.concatenate(out)


class Ranges:
    """The ranges between the edges of all intervals, by feature.

    What is told of them is kept, as bundles share most of it and it is sent along.
    """

    def __init__(self, trees: list[list[Path]]):
        edges: dict[int, set[float]] = {}
        for held, _ in itertools.chain(*trees):
            for f, (low, high, _) in held.items():
                edges.setdefault(f, set()).update(b for b in (low, high) if math.isfinite(b))
        self.edges = {f: np.array(sorted(own)) for f, own in edges.items()}
        self._told: dict[tuple[type, bytes], np.ndarray] = {}

    def told(self, f: int, bounds: frozenset[Bounds], by_class: Iterable, kind: type) -> np.ndarray:
        """For each range what is given for its class."""
        # ranges end at their upper edge, the last one nowhere
        own, classes, _, _ = _classes(bounds)
        within = np.searchsorted(own, np.append(self.edges[f], np.inf))
        values = np.array(by_class, dtype=kind)[classes[within]]
        return self._told.setdefault((kind, values.tobytes()), values)

    def places(
        self, features: list[int], bounds: dict[int, frozenset[Bounds]], kind: type = np.intp
    ) -> list[np.ndarray]:
        """By feature, what each range adds to a mail's pattern."""
        step, out = _n_patterns(bounds[f] for f in features), []
        for f in features:
            n = _classes(bounds[f])[3]
            step //= n
            out.append(self.told(f, bounds[f], range(0, n * step, step), kind))
        return out


class Bundle:
    """Neighbouring paths of a tree whose values are looked up together.

    Paths of neighbouring leaves share most of their intervals, and of the others one tells on
    the next, so together they have few more patterns than one of them has alone. What they add
    depends on a mail by a class for each of their features: numbers that fall into the same of
    the paths' intervals.
    """

    def __init__(self, paths: list[Path], bounds: dict[int, frozenset[Bounds]]):
        self.paths = paths
        self.bounds = bounds
        self.shared = [f for f, b in bounds.items() if len(b) == 1]
        self.others = [f for f, b in bounds.items() if len(b) > 1]

    @staticmethod
    def numbers(bounds: dict[int, frozenset[Bounds]]) -> int:
        """The size of the table."""
        return len(bounds) * _n_patterns(bounds.values())

    @staticmethod
    def stem_numbers(bounds: dict[int, frozenset[Bounds]]) -> int:
        """The size of the larger table of a stem, without what all paths share."""
        others = [b for b in bounds.values() if len(b) > 1]
        return (len(others) + 1) * (len(bounds) + 1) // 2 * _n_patterns(others)

    def _games(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict, dict]:
        """Gauss points, weights, leaf values, and for each feature, by class, point and path,
        its factors (see _factors) and the gain of the interval over the share, by factor."""
        points, weights = _gauss(max(len(held) for held, _ in self.paths))
        hit, share, ends = [], [], []
        for f, bounds in self.bounds.items():
            # a feature that is not on a path always holds there and has all of the weight
            own = [held.get(f, _EVERYWHERE) for held, _ in self.paths]
            inside, n_classes = _classes(bounds)[2:]
            hit += zip(*(inside[b] for b in own))
            share += [[b[2] for b in own]] * n_classes
            ends.append(len(hit))
        hit, share = (np.array(a, dtype=float)[:, None] for a in (hit, share))
        factors = share * (1 - points) + points * hit
        gains = (hit - share) / factors
        factors, gains = (
            dict(zip(self.bounds, np.split(a.reshape(len(a), -1), ends))) for a in (factors, gains)
        )
        return points, weights, np.array([value for _, value in self.paths]), factors, gains

    def table(self, ranges: Ranges) -> Table:
        """Features, places, and Shapley values by feature and pattern."""
        _, weights, leaf, factors, gains = self._games()
        weighed = (weights * leaf).ravel()
        # a pattern is one of the first features and one of the others
        features, half = list(self.bounds), len(self.bounds) // 2
        first, rest = features[:half], features[half:]
        of_first, of_rest = (_product([factors[f] for f in s], weighed.size) for s in (first, rest))
        values = _gained(of_rest, [gains[f] for f in rest]) * weighed @ of_first.T
        rows = values.reshape(len(rest), -1, len(of_first)).transpose(0, 2, 1).reshape(len(rest), -1)
        if first:
            values = _gained(of_first, [gains[f] for f in first]) @ (of_rest * weighed).T
            rows = np.concatenate([values.reshape(half, -1), rows])
        return features, ranges.places(features, self.bounds), np.ascontiguousarray(rows)

    def stem(self, ranges: Ranges) -> Stem:
        """Factors of what all paths share, and sums over the paths of the rest, by Gauss point."""
        points, weights, leaf, factors, gains = self._games()
        n_points, n_paths = len(points), len(leaf)
        product = _product([factors[f] for f in self.others], n_points * n_paths)
        sums = np.concatenate([product, _gained(product, [gains[f] for f in self.others])])
        sums = sums.reshape(len(self.others) + 1, -1, n_points, n_paths) @ leaf
        # of two halves, as patterns of all would be too many. A shared feature's gain over its
        # factor is the same for all whose interval does not hold; slopes tell it, and what is
        # added where one holds
        t = points.ravel()
        slopes, halves = [-1 / (1 - t)], []
        half = len(self.shared) // 2
        for side in (self.shared[:half], self.shared[half:]):
            terms, holds = [], []
            for f in side:
                (bounds,) = self.bounds[f]
                terms.append(np.stack([bounds[2] * (1 - t), bounds[2] * (1 - t) + t]))
                slopes.append((1 - bounds[2]) / terms[-1][1] - slopes[0])
                inside = _classes(self.bounds[f])[2][bounds]
                holds.append(ranges.told(f, self.bounds[f], inside, bool))
            halves.append((side, holds, np.ascontiguousarray(_product(terms, n_points).T)))
        places = ranges.places(self.others, self.bounds, np.int32)
        table = np.ascontiguousarray(sums.transpose(0, 2, 1))
        return halves, (self.others, places, table), weights, np.stack(slopes)


def bundles(
    trees: list[list[Path]], limit: int, numbers: Callable[[dict[int, frozenset[Bounds]]], int]
) -> list[Bundle]:
    """All paths in bundles of up to ``limit`` numbers, or more where it takes fewer in all."""
    everywhere = frozenset([_EVERYWHERE])
    out = []
    for tree in trees:
        paths, bounds, size = [], {}, 0
        for path in tree:
            one = {f: frozenset([b]) for f, b in path[0].items()}
            alone = numbers(one)
            both = {f: bounds.get(f, everywhere) | one.get(f, everywhere) for f in bounds | one}
            together = numbers(both) if paths else 0
            if paths and together > max(limit, size + alone):
                out.append(Bundle(paths, bounds))
                paths = []
            paths, bounds, size = (
                ([*paths, path], both, together) if paths else ([path], one, alone)
            )
        if paths:
            out.append(Bundle(paths, bounds))
    return out


def plan(trees: list[list[Path]], most: int = MOST_PATTERNS) -> Plan:
    """Tables of up to ``most`` numbers in all, of bundles as large as that allows, and stems."""
    ranges = Ranges(trees)
    # larger bundles than these hardly ever fit
    limit = min(_BUNDLE, 6 * most // max(1, sum(map(len, trees))))
    found = bundles(trees, limit, Bundle.numbers)
    while limit and sum(Bundle.numbers(b.bounds) for b in found) > most:
        limit = limit >> 1 if limit > 1024 else 0
        found = bundles(trees, limit, Bundle.numbers)
    tables, left = [], set()
    for bundle in sorted(found, key=lambda b: Bundle.numbers(b.bounds) / len(b.paths)):
        most -= Bundle.numbers(bundle.bounds)
        if most >= 0:
            tables.append(bundle.table(ranges))
        else:
            left.update(id(path) for path in bundle.paths)
    rest = [[path for path in tree if id(path) in left] for tree in trees]
    stems = [b.stem(ranges) for b in bundles(rest, _STEM, Bundle.stem_numbers)]
    return ranges.edges, tables, stems


def planned_values(x: np.ndarray, planned: Plan) -> np.ndarray:
    """Shapley values of every row of ``x``, one column per feature."""
    edges, tables, stems = planned
    out = np.zeros(x.shape)
    for start in range(0, len(x), _ROWS):
        rows = x[start : start + _ROWS]
        ranges = {f: np.searchsorted(own, rows[:, f]) for f, own in edges.items()}
        totals = np.zeros((x.shape[1], len(rows)))
        for columns, places, table in tables:
            pattern = places[0].take(ranges[columns[0]])
            for f, place in zip(columns[1:], places[1:]):
                pattern += place.take(ranges[f])
            for f, values in zip(columns, table):
                totals[f] += values.take(pattern)
        for halves, (others, places, sums), weights, slopes in stems:
            product, held = weights, []
            for side, holds, table in halves:
                pattern = np.zeros(len(rows), dtype=np.intp)
                for f, hold in zip(side, holds):
                    held.append((f, hold.take(ranges[f])))
                    pattern += pattern
                    pattern += held[-1][1]
                product = product * table.take(pattern, axis=1)
            pattern = np.zeros(len(rows), dtype=np.intp)
            for f, place in zip(others, places):
                pattern += place.take(ranges[f])
            looked_up = sums.take(pattern, axis=2)
            whole = slopes @ (product * looked_up[0])
            for (f, hit), value in zip(held, whole[1:]):
                totals[f] += whole[0] + hit * value
            for f, part in zip(others, looked_up[1:]):
                totals[f] += (product * part).sum(axis=0)
        out[start : start + _ROWS] = totals.T
    return out


def shap_column(spark: SparkSession, trees: list[list[Path]]) -> Callable[[Column], Column]:
    """A column function from an array of 32 numbers to its 32 Shapley values."""
    shared = spark.sparkContext.broadcast(plan(trees))
    width = len(lx.FEATURES)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def shap_udf(features: pa.Array) -> pa.Array:
        wanted = features.drop_null()
        x = np.asarray(wanted.flatten(), dtype=np.float64).reshape(len(wanted), width)
        phi = planned_values(x, shared.value)
        sizes = np.where(np.asarray(features.is_valid()), width, 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(phi.reshape(-1)))

    return shap_udf


def top_positive(values: Column, top_k: int) -> Column:
    """The largest positive values with their feature names; ties in canonical order."""
    names = F.split(F.lit("\n".join(lx.FEATURES)), "\n")
    ranked = F.sort_array(
        F.filter(
            F.transform(values, lambda v, i: F.struct((-v).alias("key"), i.alias("i"))),
            lambda t: t["key"] < 0,
        )
    )
    return F.transform(
        F.slice(ranked, 1, top_k),
        lambda t: F.struct(
            F.get(names, t["i"]).alias("feature"), F.round(-t["key"], 6).alias("value")
        ),
    )


def explainer(model, spark: SparkSession, only: Column | None = None):
    """An explainer for :func:`mailscreen.plans.screen.classify`.

    ``only`` restricts the work to the rows one wants explained, say
    ``F.col("score_final") >= 0.5``; other rows get no explanation. Without a forest
    scoring goes on unexplained; a forest that cannot be read is an error, as records
    without explanations would look like those of mails that nothing speaks against.
    """
    if model.forest is None:
        log.warning("no explanations: the model has no forest")
        trees = None
    else:
        trees, _ = tree_paths(node_table(model.forest, spark), model.forest.getNumTrees)

    def explain(scored: DataFrame, top_k: int) -> DataFrame:
        if trees is None:
            return scored.withColumn(
                "explanation_items", F.array().cast("array<struct<feature:string,value:double>>")
            )
        record = F.array(
            *(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in lx.FEATURES)
        )
        if only is not None:
            record = F.when(only, record)
        shap = shap_column(spark, trees)
        with_values = scored.withColumn("_shap", shap(record))
        explained = with_values.withColumn(
            "explanation_items", top_positive(F.col("_shap"), top_k)
        ).drop("_shap")
        # exploding items filters for mails that have some, which would explain them once more
        return settled(explained, "explanations")

    return explain


def shap_long(scored: DataFrame, key: str = "msg_id") -> DataFrame:
    """One row per mail and explained feature."""
    return scored.select(key, F.posexplode("explanation_items").alias("pos", "item")).select(
        key, (F.col("pos") + 1).alias("rank"), "item.feature", "item.value"
    )
