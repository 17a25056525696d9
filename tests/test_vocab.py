import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailscreen.functions import text, vocab
from mailscreen.operators import tfidf
from mailscreen.params import TextModelParams

TERMS = ("ab", "ab ab", "ab ab cd", "b_1", "cd", "cd ab", "ef zz", "zz", "zz ab cd")


def _texts():
    rnd = random.Random(3)
    pieces = ["ab", "AB", "cd", "b_1", "zz", "ef", "x", "é", "-", "abé", "K", "\n", "", "cdab"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice([" ", " ", "", "..", " x "]) for _ in range(rnd.randrange(40)))
             for _ in range(200)]
    # a word never reaches into the next mail, nor does a run of words
    return texts + ["", "a", "ab", "ab", "zz", "ab cd", "b", "_1", None]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3), (1, 3)])
def test_counts_are_those_of_the_ngrams(spark, low, high):
    rows = list(enumerate(_texts()))
    df = spark.createDataFrame(rows, "i int, t string").coalesce(1)
    tree = vocab.TermTree(TERMS, low, high)
    words = text.tokens(F.coalesce("t", F.lit("")))
    got = df.select(
        "i", tfidf.ngrams(words, low, high).alias("grams"),
        vocab.text_term_counts(F.lower("t"), tree).alias("a"),
        vocab.word_term_counts(words, tree).alias("b"),
    ).collect()
    assert len(got) == len(rows) and any(len(r.a.indices) > 3 for r in got)
    for r in got:
        expected = Counter(TERMS.index(g) for g in r.grams if g in TERMS)
        for sparse in (r.a, r.b):
            assert list(zip(sparse.indices, sparse.values)) == sorted(expected.items())


def test_large_batches_are_counted_in_parts(spark):
    df = spark.createDataFrame([(i, "ab cd " * 150_000) for i in range(9)], "i int, prepared_text string").coalesce(1)
    model = tfidf.TfIdf(("ab", "ab cd", "cd ab"), (1.0, 1.0, 1.0), 9, TextModelParams(sublinear_tf=False))
    rows = model.weigh(df).select("tfidf").collect()
    assert {tuple(r.tfidf.indices) for r in rows} == {(0, 1, 2)}
    assert rows[0].tfidf.weights[0] == pytest.approx(3 ** -0.5, abs=1e-4)


def test_weighing_builds_no_ngrams_as_strings(spark):
    df = spark.createDataFrame([(1, "ab cd")], "i int, prepared_text string")
    plan = tfidf.TfIdf(("ab", "zz"), (1.0, 1.0), 1).weigh(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_an_empty_vocabulary_weighs_nothing(spark):
    df = spark.createDataFrame([(1, "ab cd"), (2, "")], "i int, prepared_text string")
    assert [r.tfidf.indices for r in tfidf.TfIdf((), (), 2).weigh(df).collect()] == [[], []]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3), (1, 4)])
def test_all_terms_of_texts_and_of_word_lists(spark, low, high):
    texts = _texts()
    # keys repeat and may be null, and a mail counts its terms alone all the same
    rows = [(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "msg_id int, prepared_text string").coalesce(1)
    params = TextModelParams(ngram_min=low, ngram_max=high)
    words = df.select("msg_id", text.tokens(F.col("prepared_text")).alias(tfidf.WORDS))
    grams = words.select("msg_id", tfidf.ngrams(F.col(tfidf.WORDS), low, high).alias("g")).collect()
    expected = Counter((r.msg_id, t, n) for r in grams for t, n in Counter(r.g or []).items())
    for mails in (df, words):
        counted = tfidf.term_freq(mails, params=params)
        assert counted.dtypes == [("msg_id", "int"), ("term", "string"), ("tf", "int")]
        assert Counter(map(tuple, counted.collect())) == expected


def test_terms_of_a_long_mail_come_in_parts(spark):
    n = vocab._AT_ONCE + 10
    long = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i)), " ")
    df = spark.range(1, 3).coalesce(1).select(F.col("id").alias("msg_id"), long.alias("prepared_text"))
    row = tfidf.term_freq(df).agg(
        F.count("*").alias("rows"), F.countDistinct("msg_id", "term").alias("terms"), F.max("tf").alias("tf"),
        F.count_if(F.col("term") == f"w{n - 1} w{n}").alias("last"),
    ).first()
    assert tuple(row) == (2 * (2 * n - 1), 2 * (2 * n - 1), 1, 2)


def test_term_counts_need_no_strings_sorted_in_rows(spark):
    df = spark.createDataFrame([(1, "ab cd")], "msg_id int, prepared_text string")
    plan = tfidf.term_freq(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "sort_array" not in plan and "generate" not in plan.lower()
