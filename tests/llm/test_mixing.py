import pytest
from pyspark.sql import functions as F

from mailscreen.llm import mixing
from tests.llm.odd import clashing, empty_docs, odd_docs, rows_of

BLANK = " \t\n\x0b\x0c\r"


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    """Share, cut at the caps, share the excess, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_targets_follow_the_procedure(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 0, "é": 400, None: 50, "": 7, "z\U0001F600": 90}
    rows = [(s, n) for s, n in sizes.items()]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"))
    expected = targets_by_hand(sizes)
    for r in got.collect():
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source], abs=1e-6)
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "size", "target", "copies", "weight", "rank", "range")
    out = mixing.mixed_documents(docs)
    assert out.count() == docs.count()
    for r in out.collect():
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
    again = rows_of(mixing.mixed_documents(docs))
    assert again == rows_of(out)


def test_emitted_copies_agree_with_the_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    emitted = mixing.mix(docs)
    assert set(docs.columns) <= set(emitted.columns)
    decided = rows_of(mixing.mixed_documents(docs).filter("copies > 0"), "doc_id", "copies")
    assert rows_of(emitted.groupBy("doc_id").agg(F.count("*").alias("n"))) == decided


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(docs).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")
    )
    for r in out.collect():
        assert r.taken == pytest.approx(r.target, rel=0.06)


def test_no_documents_and_no_words(spark):
    assert mixing.mixed_documents(empty_docs(spark)).count() == 0
    assert mixing.mix(empty_docs(spark)).count() == 0
    silent = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert rows_of(mixing.mixed_documents(silent), "target", "taken") == [(0.0, 0), (0.0, 0)]
