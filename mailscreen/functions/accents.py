"""Tokens of text that was not folded to ASCII: accents go, letters of all alphabets stay."""

from __future__ import annotations

import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.functions import charsets

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.arrow_udf(T.StringType())
def _without_accents(column: pa.Array) -> pa.Array:
    def bare(x: str) -> str:
        if x.isascii():
            return x
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return pa.array([None if x is None else bare(x) for x in column.to_pylist()], pa.string())


def without_accents(c: Column) -> Column:
    """Compatibility decomposition without its combining marks; other alphabets stay.

    Spark has no function for Unicode normal forms, so this runs in Arrow batches.
    """
    return _without_accents(c)


def accented_tokens(c: Column) -> Column:
    """Lower-cased word tokens of two or more characters of text that was not folded.

    Accents go, letters of all alphabets stay. On folded text this equals ``tokens``.
    """
    word = charsets.nested_class_where(_in_word)
    return F.regexp_extract_all(without_accents(F.lower(c)), F.lit(f"{word}{{2,}}"), F.lit(0))


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"
