import random
import re

import pytest

from mailscreen.llm import line_dedup
from tests.llm.odd import OTHER, PLAIN, clashing, empty_docs, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, least):
    """Delete the windows of `least` words that equal an earlier, separate one.

    A window is a run of lines with words that is too short without its first or without
    its last line; every longer run consists of such windows.
    """
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for doc in docs:
        every = (doc[1] or "").split("\n")
        units = [(i, x, len(WORD.findall(x))) for i, x in enumerate(every)]
        units = [u for u in units if u[2]]
        gone, cut = set(), set()
        for a in range(len(units)):
            for b in range(a + 1, len(units) + 1):
                total = sum(u[2] for u in units[a:b])
                if total < least:
                    continue
                if total - max(units[a][2], units[b - 1][2]) >= least:
                    break
                seen = first.setdefault(tuple(u[1] for u in units[a:b]), (doc, a))
                if seen[0] != doc or a >= seen[1] + b - a:
                    gone |= set(range(a, b))
                    cut |= set(range(units[a][0], units[b - 1][0] + 1))
        text = doc[1]
        if cut:
            text = "\n".join(x for i, x in enumerate(every) if i not in cut)
        out[doc] = (text, len(gone))
    return out


def compare(docs, least=50):
    params = line_dedup.PassageParams(min_words=least)
    got = line_dedup.dedup_lines(docs, params).select("doc_id", "text", "n_deleted").collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = by_hand(rows, least)
    want = [(d[0], *expected[d]) for d in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def unique_ids(rows):
    """One text to an id: the order of texts with one id is that of a hash."""
    return [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i] if x[1] != r[1]}]


def test_odd_documents(spark):
    rows = unique_ids([(r.doc_id, r.text) for r in odd_docs(spark).collect()])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compare(clashing(docs, "lines", "words", "h", "g", "w", "first", "n", "cut_runs", "k1"))


@pytest.mark.parametrize("seed", range(4))
def test_random_lines(spark, seed):
    draw = random.Random(seed)
    pool = [" ".join(draw.choice("xyz") for _ in range(draw.randrange(1, 6))) for _ in range(6)]
    rows = [
        (i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(0, 14)))) for i in range(40)
    ]
    compare(spark.createDataFrame(rows, "doc_id long, text string"), least=8)


def test_first_occurrence_stays_whole(spark):
    rows = [(1, "\n".join([PLAIN] * 4)), (2, f"Start\n{PLAIN}\n\n{OTHER}\nEnd"), (3, OTHER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: PLAIN, 2: f"Start\n\n{OTHER}\nEnd", 3: ""}


def test_short_repeats_stay(spark):
    rows = [(i, f"All rights reserved.\nText number {i}.") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_deleted for r in line_dedup.dedup_lines(docs).collect()} == {0}


def test_no_documents(spark):
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0
