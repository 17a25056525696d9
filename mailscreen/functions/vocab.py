"""Counting terms in mails, in Arrow batches: those of a fitted vocabulary, or all.

Words are looked up among the words of the vocabulary, and runs of known words in the tree
of its terms, level by level. Only positions whose words so far open a term go on, so no
n-gram is put together as a string, and lookups are exact.

Where all terms are wanted, words and runs of words are numbered, and the numbers are
sorted and counted. A term becomes a string once for each mail it is in.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.functions.counted import _slices

# executors need not have this package installed: ship the kernel itself
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_COUNTS = T.StructType([
    T.StructField("indices", T.ArrayType(T.IntegerType())),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])
_TOKEN_BYTES = np.zeros(256, bool)
_TOKEN_BYTES[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = True
# words of a batch that are counted at a time
_AT_ONCE = 500_000


class TermTree:
    """The terms of a vocabulary as runs of its words."""

    def __init__(self, terms: tuple[str, ...], low: int, high: int):
        self.n_terms = len(terms)
        runs = {t: t.split(" ") for t in terms}
        runs = {t: r for t, r in runs.items() if low <= len(r) <= high and all(r)}
        self.words = list(dict.fromkeys(w for r in runs.values() for w in r))
        word_id = {w: i for i, w in enumerate(self.words)}
        # a level has the sorted keys of its nodes (parent and word) and the term of each, or -1
        self.levels = []
        index = {t: i for i, t in enumerate(terms)}
        prefixes = {(): 0}
        for n in range(1, max(map(len, runs.values()), default=0) + 1):
            here = {}
            for t, r in runs.items():
                if len(r) >= n:
                    key = prefixes[tuple(r[: n - 1])] * len(self.words) + word_id[r[n - 1]]
                    here.setdefault(key, (tuple(r[:n]), -1))
                    if len(r) == n:
                        here[key] = (tuple(r), index[t])
            keys = sorted(here)
            prefixes = {here[k][0]: i for i, k in enumerate(keys)}
            self.levels.append((
                np.array(keys, np.int64), np.array([here[k][1] for k in keys], np.int64)
            ))

    def count(self, words: pa.Array, row: np.ndarray, n_rows: int):
        """(lengths, indices, counts) of the terms of each row, in term order."""
        known = pc.index_in(words, value_set=pa.array(self.words, words.type))
        ids = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.flatnonzero(ids >= 0)
        node = np.zeros(len(at), np.int64)
        found = [np.zeros(0, np.int64)]
        for n, (keys, term) in enumerate(self.levels):
            inside = at + n < len(ids)
            at, node = at[inside], node[inside]
            goes_on = (row[at + n] == row[at]) & (ids[at + n] >= 0)
            at, node = at[goes_on], node[goes_on]
            key = node * len(self.words) + ids[at + n]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[node] == key
            at, node = at[same], node[same]
            here = term[node]
            found.append((row[at] * self.n_terms + here)[here >= 0])
        cells, counts = np.unique(np.concatenate(found), return_counts=True)
        of_row = cells // max(self.n_terms, 1)
        return np.bincount(of_row, minlength=n_rows), cells - of_row * self.n_terms, counts


def _words_in(data: np.ndarray, offsets: np.ndarray):
    """Tokens (runs of two or more of a-z, 0-9 and _) of lower-cased strings, and their rows."""
    n = len(data)
    inside = _TOKEN_BYTES[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:]))
    lengths = ends - starts + 1
    inside[starts[lengths == 1]] = False
    starts, lengths = starts[lengths > 1], lengths[lengths > 1]
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=to[1:])
    words = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(data[inside]))
    )
    return words, np.searchsorted(offsets, starts, side="right") - 1


def _word_lists(lists: pa.Array):
    """(start, stop, words, their rows) of runs of lists of a bounded number of words."""
    flat = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(sizes, out=to[1:])
    start = 0
    while start < len(lists):
        limit = int(np.searchsorted(to, to[start] + _AT_ONCE, side="right")) - 1
        stop = min(len(lists), max(start + 1, limit))
        row = np.repeat(np.arange(stop - start), sizes[start:stop])
        yield start, stop, flat.slice(int(to[start]), int(to[stop] - to[start])), row
        start = stop


def _texts_in_words(texts: pa.Array):
    """The same of lower-cased texts."""
    for start, stop, data, offsets in _slices(texts):
        yield start, stop, *_words_in(data, offsets)


def _all_terms(words: pa.Array, row: np.ndarray, low: int, high: int):
    """(rows, terms, counts) of the terms of each row, some hundred thousand at a time."""
    encoded = words.dictionary_encode()
    names = encoded.dictionary
    ids = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at, node = np.arange(len(ids)), ids
    # the words of each run of n - 1 words that is numbered in ``node``
    parts = [np.arange(len(names))]
    for n in range(1, high + 1):
        run, n_runs = node, max(len(names), 1)
        if n > 1:
            goes_on = np.flatnonzero(at + (n - 1) < len(ids))
            goes_on = goes_on[row[at[goes_on] + (n - 1)] == row[at[goes_on]]]
            at = at[goes_on]
            run, n_runs = node[goes_on] * len(names) + ids[at + (n - 1)], len(parts[0]) * len(names)

        def words_of(runs: np.ndarray, n=n, parts=parts) -> list[np.ndarray]:
            before = [p[runs // len(names)] for p in parts]
            return [runs] if n == 1 else [*before, runs % len(names)]

        if n >= low:
            cells, counts = np.unique(row[at] * n_runs + run, return_counts=True)
            for i in range(0, len(cells), _AT_ONCE):
                of_row, of_run = np.divmod(cells[i : i + _AT_ONCE], n_runs)
                columns = [names.take(pa.array(p)) for p in words_of(of_run)]
                space = pa.scalar(" ", names.type)
                terms = columns[0] if n == 1 else pc.binary_join_element_wise(*columns, space)
                yield of_row, terms, counts[i : i + _AT_ONCE]
        if 1 < n < high:
            runs, node = np.unique(run, return_inverse=True)
            parts = words_of(runs)


def _listed(parts: list, n_rows: int) -> pa.Array:
    lengths, indices, counts = (
        np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(3)
    )
    to = np.zeros(n_rows + 1, np.int32)
    np.cumsum(lengths, out=to[1:])
    to = pa.array(to)
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(to, pa.array(indices.astype(np.int32))),
         pa.ListArray.from_arrays(to, pa.array(counts.astype(np.float64)))],
        names=["indices", "values"],
    )


def text_term_counts(lowered: Column, tree: TermTree) -> Column:
    """Sparse counts of the tree's terms in lower-cased texts: indices and values."""
    @F.arrow_udf(_COUNTS)
    def kernel(texts: pa.Array) -> pa.Array:
        parts = [tree.count(words, row, stop - start) for start, stop, words, row in _texts_in_words(texts)]
        return _listed(parts, len(texts))

    return kernel(lowered)


def word_term_counts(words: Column, tree: TermTree) -> Column:
    """Sparse counts of the tree's terms in lists of words: indices and values."""
    @F.arrow_udf(_COUNTS)
    def kernel(lists: pa.Array) -> pa.Array:
        parts = [tree.count(words, row, stop - start) for start, stop, words, row in _word_lists(lists)]
        return _listed(parts, len(lists))

    return kernel(words)


def all_term_counts(mails: DataFrame, low: int, high: int) -> DataFrame:
    """One row per mail and term with its count ``tf``.

    ``mails`` has a key, and lower-cased texts or lists of words.
    """
    key, source = mails.schema
    parted = _word_lists if isinstance(source.dataType, T.ArrayType) else _texts_in_words
    schema = T.StructType([
        key, T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())
    ])
    names = schema.names

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, words, row in parted(batch.column(1)):
                for of_row, terms, counts in _all_terms(words, row, low, high):
                    keys = batch.column(0).take(pa.array(start + of_row))
                    tf = pa.array(counts.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([keys, terms.cast(pa.string()), tf], names)

    return mails.mapInArrow(kernel, schema)
