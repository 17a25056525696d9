"""Every stage against a plain Python version, and the whole on odd rows."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from mailscreen.llm import quality_rules
from tests.llm.odd import SCHEMA, clashing, empty_docs, odd_docs
from tests.llm.test_decontamination import by_hand as contaminated_by_hand
from tests.llm.test_line_dedup import by_hand as deduped_by_hand
from tests.llm.test_simhash import plain_fingerprint, reachable


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    verdicts = quality_rules.quality(docs).filter("kept")
    kept = pipeline.apply_quality_rules(spark, docs, sf_dir)
    assert ids(kept) == ids(verdicts) and kept.columns == docs.columns

    done = pipeline.dedup_lines(spark, kept, sf_dir)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    expected = deduped_by_hand(rows, 50)
    want = {d[0]: expected[d][0] for d in rows if not (expected[d][1] and not expected[d][0].strip())}
    assert {r.doc_id: r.text for r in done.collect()} == want
    assert all(r.n_chars == len(r.text) for r in done.collect()) and done.columns == docs.columns

    single = pipeline.drop_near_duplicates(spark, done, sf_dir)
    prints = {i: plain_fingerprint(t) for i, t in want.items()}
    root = reachable(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, x in prints.items():
        least[root[x]] = min(least.get(root[x], i), i)
    assert ids(single) == sorted(least.values()) and single.columns == docs.columns

    clean = pipeline.decontaminate(spark, single, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    marks = contaminated_by_hand([(i, want[i]) for i in least.values()], items)
    assert ids(clean) == sorted(x[0] for x in marks if not x[-1]) and clean.columns == docs.columns

    mixed = pipeline.mix(spark, clean, sf_dir)
    per = mixed.groupBy("doc_id").agg(F.count("*").alias("n"), F.first("copies").alias("c"))
    assert per.filter("n <> c").count() == 0
    assert set(ids(mixed)) <= set(ids(clean))


def test_run_and_registration(spark, sf_dir):
    assert entry.queries()["pipeline"] is pipeline.run
    assert [n for n, _ in pipeline.STAGES] == [
        "quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing"
    ]
    once, again = (pipeline.run(spark, sf_dir) for _ in range(2))
    assert once.count() > 0
    assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_odd_rows(spark, sf_dir):
    docs = clashing(odd_docs(spark), "document", "votes", "runs", "n_deleted", "hash", "size")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.collect()
    pipeline.mix(spark, docs, sf_dir).collect()


def test_no_documents(spark, sf_dir):
    docs = empty_docs(spark)
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).select("doc_id", "text", "lang", "source", "n_chars").collect(), SCHEMA)
    assert docs.count() == 0
