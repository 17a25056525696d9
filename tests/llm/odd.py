"""Tables with the odd cases that every operator has to stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PLAIN = (
    "The ferry left the harbour before dawn and crossed the bay in fog so thick that the mate "
    "stood at the bow with a lamp and a bell while the captain counted minutes by his watch "
    "and listened for the buoy that marks the bar where two ships had gone down that winter."
)
OTHER = (
    "Nobody in the village remembered who had planted the row of limes along the road, though "
    "each spring somebody asked, and each time the oldest person present would look at the "
    "trees, shake a head, and say that they had always been as tall as this, or even taller, back when the road was only a track."
)
LONG = "\n".join(f"Line {i} of a very long text with its own number {i * i}." for i in range(8_000))
SHOUT = " ".join(f"BUY{i % 7}NOW!! CHEAP$$$ {i}###" for i in range(80))

# doc_id, text, lang, source, n_chars: nulls everywhere, empty and blank texts, ties,
# repeated rows, repeated ids, copies, shouting, one very long text, characters beyond the BMP
ROWS = [
    (1, PLAIN, "en", "a", len(PLAIN)),
    (2, PLAIN, "en", "b", len(PLAIN)),
    (2, PLAIN, "en", "b", len(PLAIN)),
    (3, OTHER + "\n" + PLAIN, "en", "a", 0),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \n\t\r\n ", "en", None, 6),
    (None, OTHER, "en", "a", len(OTHER)),
    (None, None, None, None, None),
    (7, LONG, "en", "c", len(LONG)),
    (8, SHOUT, "en", "c", len(SHOUT)),
    (9, OTHER, "en", "", len(OTHER)),
    (9, "Another text of the same id.", "en", "é", 28),
    (10, "\U0001F600 éÉ 中文 wörter ÜBER  x \x1c y", "xx", "\U0001F600", 1),
    (11, "one", "en", "a", 3),
    (-5, PLAIN.replace("fog", "mist"), "en", "b", len(PLAIN) + 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def clashing(df: DataFrame, *names: str) -> DataFrame:
    """The table with further columns, named as an operator might name its own."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(f"own {n}") for n in names})


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def rows_of(df: DataFrame, *names: str) -> list[tuple]:
    got = df.select(*names) if names else df
    return sorted((tuple(r) for r in got.collect()), key=repr)
