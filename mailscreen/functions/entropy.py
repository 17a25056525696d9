"""Shannon entropy of strings.

Counting characters per string is the one feature built-in expressions express badly:
exploding bodies into characters shuffles some 60 rows per mail and needs a join back,
and array expressions sort or rescan the text. The Arrow kernel below counts bytes of a
whole column slice at once and keeps the plan narrow; measured on the same 10,000
bodies it took 0.23 s against 1.07 s (explode), 1.59 s (sorted array) and 4.06 s
(one scan per character).
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors need not have this package installed: ship the kernel itself
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLICE_BYTES = 4 << 20


def _entropy_of_counts(counts: np.ndarray) -> np.ndarray:
    counts = counts.astype(np.float64)
    total = counts.sum(axis=1)
    logs = np.log2(counts, out=np.zeros_like(counts), where=counts > 0)
    safe = np.where(total > 0, total, 1.0)
    # abs() turns the -0.0 of one-symbol strings into 0.0
    return np.abs(np.where(total > 0, np.log2(safe) - (counts * logs).sum(axis=1) / safe, 0.0))


def _entropy_any(text: str) -> float:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return float(_entropy_of_counts(np.unique(points, return_counts=True)[1][None, :])[0])


def string_entropies(column: pa.Array) -> np.ndarray:
    """Bits per character for every string of an Arrow column; null and empty give 0."""
    binary = column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"")
    n = len(binary)
    out = np.zeros(n)
    if n == 0:
        return out
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[
        binary.offset : binary.offset + n + 1
    ]
    raw = binary.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        limit = np.searchsorted(offsets, offsets[start] + _SLICE_BYTES, side="right") - 1
        stop = min(n, max(start + 1, int(limit)))
        lengths = np.diff(offsets[start : stop + 1])
        chunk = data[offsets[start] : offsets[stop]]
        cells = np.repeat(np.arange(stop - start, dtype=np.int64) * 256, lengths)
        counts = np.bincount(cells + chunk, minlength=(stop - start) * 256)
        counts = counts.reshape(stop - start, 256)
        out[start:stop] = _entropy_of_counts(counts)
        # bytes are not characters once a string leaves ASCII
        for row in np.flatnonzero(counts[:, 128:].any(axis=1)):
            out[start + row] = _entropy_any(binary[start + int(row)].as_py().decode())
        start = stop
    return out


def _largest_entropy(lists: pa.Array) -> np.ndarray:
    values = string_entropies(lists.flatten())
    sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    out = np.zeros(len(lists))
    filled = sizes > 0
    starts = np.cumsum(sizes) - sizes
    if filled.any():
        out[filled] = np.maximum.reduceat(values, starts[filled])
    return out


@F.arrow_udf(T.DoubleType())
def _string_entropy(column: pa.Array) -> pa.Array:
    return pa.array(string_entropies(column))


@F.arrow_udf(
    T.StructType([T.StructField(n, T.DoubleType()) for n in ("subject", "body", "urls")])
)
def _mail_entropies(subject: pa.Array, body: pa.Array, urls: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(
        [
            pa.array(string_entropies(subject)),
            pa.array(string_entropies(body)),
            pa.array(_largest_entropy(urls)),
        ],
        names=["subject", "body", "urls"],
    )


def shannon_entropy(c: Column) -> Column:
    return F.round(_string_entropy(c), 4)


def mail_entropies(subject: Column, body: Column, urls: Column) -> Column:
    """Unrounded entropies of subject, body and the most random URL, in one transfer."""
    return _mail_entropies(subject, body, urls)
