"""TF-IDF as relational aggregation plus narrow, per-row weighting.

Cleaning a mail is the costly part, so fitting works on a corpus of tokenized mails that is
written once (see ``tokenized``). The vocabulary takes two rounds over it. The first counts
64-bit hashes of terms, and the totals it finds tell which of them can be among the most
frequent; the second brings the strings of those alone, as many as the vocabulary has
terms, ties aside. Weighting a mail needs only the vocabulary, whose size is a parameter,
so it runs without any shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen.functions import text, vocab
from mailscreen.functions.text import let
from mailscreen.params import TextModelParams
from mailscreen.session import settled, work_folder

# column of a tokenized mail
WORDS = "mail_words"
# so many hashes of terms are sent to every task, some 50 MB; more are joined by shuffle
BROADCAST_TERMS = 2_000_000


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of the token list for n in low..high, words joined by a space."""
    def build(words: Column) -> Column:
        grams, parts = words, [words] if low == 1 else []
        for n in range(2, high + 1):
            following = F.slice(words, F.lit(n), F.greatest(F.size(words), F.lit(1)))
            # the longer side of the zip ends in nulls, and concat keeps them null
            grams = F.array_compact(
                F.zip_with(grams, following, lambda a, b: F.concat(a, F.lit(" "), b))
            )
            if n >= low:
                parts.append(grams)
        return F.concat(*parts)

    return let(tokens, build)


def mail_grams(prepared: Column, params: TextModelParams = TextModelParams()) -> Column:
    return ngrams(text.tokens(prepared), params.ngram_min, params.ngram_max)


def tokenized(corpus: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and words of every mail, written to the work folder.

    What is fitted on it and weighed with it reads words instead of cleaning mails again.
    """
    path = work_folder(corpus.sparkSession, "tokenized-mails")
    words = corpus.select(*keep, text.tokens(F.col("prepared_text")).alias(WORDS))
    words.write.parquet(path)
    return corpus.sparkSession.read.schema(words.schema).parquet(path)


def _words(df: DataFrame, text_column: str = "prepared_text") -> Column:
    return F.col(WORDS) if WORDS in df.columns else text.tokens(F.col(text_column))


def term_freq(
    corpus: DataFrame, key: str = "msg_id", params: TextModelParams = TextModelParams()
) -> DataFrame:
    """Counts per mail and term."""
    words = F.col(WORDS) if WORDS in corpus.columns else F.lower(F.col("prepared_text"))
    mails = corpus.select(key, words.alias(WORDS))
    return vocab.all_term_counts(mails, params.ngram_min, params.ngram_max)


def _counted(terms: DataFrame) -> DataFrame:
    """df and total of every value of the column ``terms``, an array per mail.

    Sorted values stand beside the one before them, so that a mail counts where they
    differ; nothing is counted in the row, and rows combine before the shuffle.
    """
    ordered = terms.select(F.sort_array("terms").alias("terms"))
    none = F.array(F.lit(None).cast(terms.schema["terms"].dataType.elementType))
    shifted = F.concat(none, F.col("terms"))  # one longer: its last value stands beside null
    pairs = F.explode(F.arrays_zip(F.col("terms").alias("term"), shifted.alias("before")))
    return (
        ordered.select(pairs.alias("p")).select("p.*").filter("term is not null")
        .groupBy("term")
        .agg(
            F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("df"),
            F.count("*").alias("total"),
        )
    )


def doc_freq(corpus: DataFrame, params: TextModelParams = TextModelParams()) -> DataFrame:
    """Mails containing each term and its total count: one shuffle, keyed on the term."""
    return _counted(
        corpus.select(
            ngrams(_words(corpus), params.ngram_min, params.ngram_max).alias("terms")
        )
    )


def _runs(words: Column, n: int) -> Column:
    """Structs of n words that follow one another."""
    length = F.greatest(F.size(words) - (n - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(words, k + 1, length).alias(f"w{k}") for k in range(n)])


def _hash(n: int) -> Callable[[Column], Column]:
    return lambda run: F.xxhash64(*[run[f"w{k}"] for k in range(n)])


def _term_hashes(words: Column, params: TextModelParams) -> Column:
    sizes = range(params.ngram_min, params.ngram_max + 1)
    return F.concat(*[F.transform(_runs(words, n), _hash(n)) for n in sizes])


def _occurrences(corpus: DataFrame, wanted: DataFrame, params: TextModelParams) -> DataFrame:
    """(hash, term) of every occurrence of the wanted hashes; only these become strings."""
    found = None
    for n in range(params.ngram_min, params.ngram_max + 1):
        runs = corpus.select(F.explode(_runs(F.col(WORDS), n)).alias("run"))
        terms = (
            runs.withColumn("hash", _hash(n)(F.col("run"))).join(wanted, "hash", "left_semi")
            .select("hash", F.concat_ws(" ", *[F.col(f"run.w{k}") for k in range(n)]).alias("term"))
        )
        found = terms if found is None else found.union(terms)
    return found


def _top_terms(counts: DataFrame, params: TextModelParams) -> DataFrame:
    return (
        counts.filter(F.col("df") >= params.min_df)
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(params.max_features)
    )


def vocabulary(
    corpus: DataFrame, params: TextModelParams = TextModelParams()
) -> DataFrame:
    """The most frequent terms found in enough mails; ties go to the smaller term.

    A hash counts at least as often as each of its terms, so terms whose hash has too few
    mails or too small a total are out. If each hash that is left stands for one term, its
    counts are those of the term; should two terms ever share one, strings are counted.
    """
    if WORDS not in corpus.columns:
        corpus = tokenized(corpus, [])
    spark = corpus.sparkSession
    hashed = _counted(corpus.select(_term_hashes(F.col(WORDS), params).alias("terms")))
    path = work_folder(spark, "term-hashes")
    frequent = hashed.filter(F.col("df") >= params.min_df).withColumnRenamed("term", "hash")
    frequent.write.parquet(path)
    frequent = spark.read.schema(frequent.schema).parquet(path)
    largest = frequent.orderBy(F.desc("total")).limit(params.max_features)
    cut, n = largest.agg(F.min("total"), F.count("*")).first()
    # with a full vocabulary nothing below its smallest total is looked at again
    chosen = frequent.filter(F.col("total") >= cut) if n == params.max_features else frequent
    wanted = chosen.select("hash")
    if chosen.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    path = work_folder(spark, "term-names")
    names = _occurrences(corpus, wanted, params).groupBy("hash").agg(
        F.min("term").alias("term"), F.max("term").alias("other")
    )
    names.write.parquet(path)
    names = spark.read.schema(names.schema).parquet(path)
    if names.filter(F.col("term") != F.col("other")).limit(1).count():
        return _top_terms(doc_freq(corpus, params), params)
    return _top_terms(chosen.join(names, "hash").select("term", "df", "total"), params)


@dataclass(frozen=True)
class TfIdf:
    """A fitted vocabulary, in term order, with its inverse document frequencies."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    n_docs: int
    params: TextModelParams = TextModelParams()

    def weigh(self, df: DataFrame, text_column: str = "prepared_text") -> DataFrame:
        """Append ``tfidf``: sparse indices and L2-normalised weights of each text.

        Tokenized mails lose their words here.
        """
        keep = [c for c in df.columns if c != WORDS]
        tree = vocab.TermTree(self.terms, self.params.ngram_min, self.params.ngram_max)
        if WORDS in df.columns:
            counts = vocab.word_term_counts(F.col(WORDS), tree)
        else:
            counts = vocab.text_term_counts(F.lower(F.col(text_column)), tree)
        idf = F.from_json(F.lit(json.dumps(self.idf)), "array<double>")

        def weight(index: Column, tf: Column) -> Column:
            scaled = 1.0 + F.log(tf) if self.params.sublinear_tf else tf
            return scaled * F.get(idf, index)

        def normalised(weights: Column) -> Column:
            norm = F.sqrt(F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w * w))
            return let(norm, lambda n: F.transform(weights, lambda w: w / n))

        sparse = df.select(*keep, counts.alias("_v"))
        weighed = sparse.select(
            *keep,
            F.struct(
                F.col("_v.indices").alias("indices"),
                let(F.zip_with("_v.indices", "_v.values", weight), normalised).alias("weights"),
            ).alias("tfidf"),
        )
        return settled(weighed, "tfidf")

    def long(self, df: DataFrame, key: str = "msg_id", text_column: str = "prepared_text"):
        """One row per mail and vocabulary term: term and weight."""
        names = F.from_json(F.lit(json.dumps(self.terms)), "array<string>")
        source = WORDS if WORDS in df.columns else text_column
        weighed = self.weigh(df.select(key, source), text_column)
        pairs = F.arrays_zip(
            F.col("tfidf.indices").alias("i"), F.col("tfidf.weights").alias("w")
        )
        return weighed.select(key, F.explode(pairs).alias("p")).select(
            key, F.get(names, F.col("p.i")).alias("term"), F.col("p.w").alias("weight")
        )


def fit(corpus: DataFrame, params: TextModelParams = TextModelParams()) -> TfIdf:
    """Fit vocabulary and inverse document frequencies on a tokenized corpus.

    Mails that are not tokenized yet are written so first. The vocabulary is the one thing brought to the driver; ``max_features`` bounds it.
    """
    if WORDS not in corpus.columns:
        corpus = tokenized(corpus, [])
    n_docs = corpus.count()
    rows = vocabulary(corpus, params).select(
        "term", (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1).alias("idf")
    ).collect()
    rows.sort(key=lambda r: r.term)
    return TfIdf(tuple(r.term for r in rows), tuple(r.idf for r in rows), n_docs, params)
