"""Entropies, character counts and lexicon hits of mails in one Arrow transfer.

Whoever wants all features sends every body to the entropy kernel anyway. Its byte counts
hold the numbers of digits, signs, capitals and spaces of folded (ASCII) text, and lexicon
terms are found there by one pass for all of them, where native expressions scan the text
once for each prefix.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen import lexicons as lx
from mailscreen.functions import text
from mailscreen.functions.entropy import (
    _SLICE_BYTES, _entropy_of_counts, _largest_entropy, string_entropies,
)

# executors need not have this package installed: ship the kernel itself
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BUCKETS = 32
_KIND = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("subject", "body", "urls")]
    + [T.StructField(n, T.IntegerType())
       for n in ("digits", "special", "upper", "exclaim", "spaces", "urgency", "brands",
                 "subject_urgency", "subject_brands")]
)


class TermFinder:
    """Distinct terms that occur in ASCII strings, whatever their case.

    A position can begin a term only if its first and its second pair of characters agree
    with those of one bucket of terms; the few that do are compared byte by byte.
    """

    def __init__(self, terms: tuple[str, ...]):
        self.terms = [t.encode() for t in terms]
        self.first = np.zeros(1 << 16, np.uint32)
        self.second = np.zeros(1 << 16, np.uint32)
        any_byte = range(256)
        for i, t in enumerate(self.terms):
            bit = np.uint32(1 << (i % _BUCKETS))
            for table, pair in ((self.first, t[0:2]), (self.second, t[2:4])):
                for a in pair[0:1] or any_byte:
                    for b in pair[1:2] or any_byte:
                        table[a | b << 8] |= bit

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many terms occur in each string; ``offsets`` begin at 0."""
        n, rows = len(data), len(offsets) - 1
        low = np.zeros(n + max(map(len, self.terms)) + 4, np.uint8)
        low[:n] = _LOWER[data]
        pairs = low[:-1] | (low[1:].astype(np.uint16) << 8)
        found = np.flatnonzero(self.first[pairs[:n]] & self.second[pairs[2 : n + 2]])
        row_of = np.searchsorted(offsets, found, side="right") - 1
        left = offsets[row_of + 1] - found
        head = pairs[found].astype(np.uint32) | (pairs[found + 2].astype(np.uint32) << 16)
        total = np.zeros(rows, np.int32)
        for t in self.terms:
            mask = np.uint32((1 << 8 * min(len(t), 4)) - 1)
            hit = np.flatnonzero((head & mask) == np.uint32(int.from_bytes(t[:4], "little")))
            hit = hit[left[hit] >= len(t)]
            for j in range(4, len(t)):
                hit = hit[low[found[hit] + j] == t[j]]
            total[np.unique(row_of[hit])] += 1
        return total


def _slices(column: pa.Array):
    """(start, stop, bytes, offsets from 0) of runs of strings of some megabytes."""
    binary = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    n = len(binary)
    if n == 0:
        return
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + n + 1]
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        limit = np.searchsorted(offsets, offsets[start] + _SLICE_BYTES, side="right") - 1
        stop = min(n, max(start + 1, int(limit)))
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop


def _bytes_in(column: pa.Array) -> np.ndarray:
    """How often each byte stands in each string."""
    counts = np.zeros((len(column), 256), np.int32)
    for start, stop, data, offsets in _slices(column):
        cells = np.repeat(np.arange(stop - start, dtype=np.int64) * 256, np.diff(offsets))
        counts[start:stop] = np.bincount(cells + data, minlength=(stop - start) * 256).reshape(-1, 256)
    return counts


def _terms_in(column: pa.Array, finder: TermFinder) -> np.ndarray:
    total = np.zeros(len(column), np.int32)
    for start, stop, data, offsets in _slices(column):
        total[start:stop] = finder.count(data, offsets)
    return total


def mail_counts(subject: Column, body: Column, urls: Column, fold_lexicon: bool = False) -> Column:
    """Unrounded entropies as in ``entropy.mail_entropies``, counts of the folded body, and
    lexicon terms of subject and body together and of the subject alone."""
    urgency = TermFinder(text.lexicon_terms(lx.URGENCY_TERMS, fold_lexicon))
    brands = TermFinder(lx.BRAND_TERMS)
    special = np.frombuffer(lx.ASCII_SPECIAL.encode(), np.uint8)

    @F.arrow_udf(_KIND)
    def kernel(subject: pa.Array, body: pa.Array, urls: pa.Array) -> pa.Array:
        subject, body = (c.cast(pa.large_string()).fill_null("") for c in (subject, body))
        both = pc.binary_join_element_wise(subject, body, pa.scalar(" ", pa.large_string()))
        counts = _bytes_in(body)
        columns = [
            string_entropies(subject),
            _entropy_of_counts(counts),
            _largest_entropy(urls),
            counts[:, ord("0") : ord("9") + 1].sum(axis=1),
            counts[:, special].sum(axis=1),
            counts[:, ord("A") : ord("Z") + 1].sum(axis=1),
            counts[:, ord("!")],
            counts[:, ord(" ")],
            _terms_in(both, urgency), _terms_in(both, brands),
            _terms_in(subject, urgency), _terms_in(subject, brands),
        ]
        kinds = [pa.float64()] * 3 + [pa.int32()] * 9
        return pa.StructArray.from_arrays(
            [pa.array(c, type=k) for c, k in zip(columns, kinds)], names=_KIND.names
        )

    return kernel(subject, body, urls)
