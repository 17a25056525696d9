import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mailscreen.operators import corpus
from mailscreen.params import RequestLimits, SplitParams
from mailscreen.sources import csv_corpora, requests, tables


def write(folder, name, text, encoding="utf-8"):
    (folder / name).write_bytes(text.encode(encoding))


@pytest.fixture
def raw(tmp_path):
    write(tmp_path, "CEAS_08.csv",
          'sender,receiver,date,subject,body,label\n'
          'a,b,c,Hi,"line one\nline two",1\n'
          'a,b,c,,only body,0.0\n'
          'a,b,c,only subject,,ham\n'
          'a,b,c, ,  ,1\n'
          'a,b,c,too,many,1,cells,here\n'
          'a,b,c,short row\n'
          'a,b,c,"say ""hi""",quoted,TRUE\n')
    write(tmp_path, "Enron.csv", "Subject,Message,Spam\nHi,same text,Spam\nx,y,Benign\n")
    write(tmp_path, "Ling.csv", "text,spamclass\nrésumé,yes\n", "latin-1")
    write(tmp_path, "Nazario.csv", "sender,receiver,date,urls,body\na,b,c,1,bad mail\n")
    write(tmp_path, "Nigerian_Fraud.csv", "subject,message,spam\nhello,prince,0\n")
    write(tmp_path, "phishing_email.csv", "text_combined,label\nall in one,1\n")
    write(tmp_path, "SpamAssasin.csv", "v1,text\nmaybe,unknown label\n1,fine\n")
    return tmp_path


def test_build_unified(spark, raw):
    rows = csv_corpora.build_unified(spark, str(raw)).collect()
    got = {(r.dataset_source, r.subject, r.body, r.label) for r in rows}
    assert got == {
        ("CEAS_08", "Hi", "line one\nline two", 1),
        ("CEAS_08", "", "only body", 0),
        ("CEAS_08", "only subject", "", 0),
        ("CEAS_08", "short row", "", 0),
        ("CEAS_08", 'say "hi"', "quoted", 1),
        ("Enron", "Hi", "same text", 1),
        ("Enron", "x", "y", 0),
        ("Ling", "", "résumé", 1),
        ("Nazario", "", "bad mail", 1),
        ("Nigerian_Fraud", "hello", "prince", 0),
        ("phishing_email", "", "all in one", 1),
        # SpamAssasin holds an unknown label and is dropped as a whole
    }
    for r in rows:
        expected = hashlib.md5(f"{r.subject}\x00{r.body}".encode()).hexdigest()
        assert r.content_hash == expected


def test_malformed_rows_are_set_aside(spark, raw):
    _, malformed = csv_corpora.read_csv(spark, [str(raw / "CEAS_08.csv")])
    assert malformed.count() == 1


def test_set_aside_rows_are_written(spark, raw, tmp_path):
    csv_corpora.build_unified(spark, str(raw), ["CEAS_08"], rejects=str(tmp_path / "rejects"))
    rows = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert [r.dataset_source for r in rows] == ["CEAS_08"] and len(rows[0].cells) > 3


def test_part_files_of_different_order_and_encoding(spark, tmp_path):
    folder = tmp_path / "CEAS_08.csv"
    folder.mkdir()
    write(folder, "part-0.csv", "subject,body,label\ns0,b0 é,0\n")
    write(folder, "part 1.csv", "label,subject,body\n1,s1,b1 é\n", "latin-1")
    write(folder, "part-2.csv", "body,label,subject,more\nb2,1,s2,x\n")
    spec = corpus.source_spec("CEAS_08")
    rows, malformed = csv_corpora.load_parts(spark, spec, str(tmp_path))
    assert sorted(map(tuple, rows.select("subject", "body", "label", "more").collect())) == [
        ("s0", "b0 é", "0", None), ("s1", "b1 é", "1", None), ("s2", "b2", "1", "x"),
    ]
    assert malformed.count() == 0


def test_no_text_is_shuffled_to_find_copies(spark, sf_dir):
    from catalog.spark_queries import QUERIES

    for name in ("dedup_by_hash", "stratified_split", "class_balance"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        shuffled = plan[: plan.rindex("Exchange hashpartitioning(content_hash")]
        for line in shuffled.split("\n"):
            assert "body#" not in line and "subject#" not in line, line


def test_dedup_of_whole_rows(spark):
    rows = [(1, "Ling", "s", "b", 0, "h"), (2, "CEAS_08", "s", "b", 1, "h"), (3, "x", "t", "c", 0, "k")]
    df = spark.createDataFrame(
        rows, "msg_id int, dataset_source string, subject string, body string, label int, content_hash string"
    )
    assert sorted(map(tuple, corpus.dedup_by_hash(df).collect())) == rows[1:]


def test_subset_and_missing_sources(spark, raw, tmp_path_factory):
    some = csv_corpora.build_unified(spark, str(raw), ["Enron", "Nazario"])
    assert {r.dataset_source for r in some.collect()} == {"Enron", "Nazario"}
    with pytest.raises(ValueError, match="unknown sources"):
        csv_corpora.build_unified(spark, str(raw), ["Nope"])
    with pytest.raises(RuntimeError):
        csv_corpora.build_unified(spark, str(tmp_path_factory.mktemp("empty")))


def test_directory_of_part_files(spark, tmp_path):
    folder = tmp_path / "Enron.csv"
    folder.mkdir()
    for i in range(3):
        write(folder, f"part-{i}.csv", f"subject,message,spam\ns{i},m{i},{i % 2}\n")
    df = csv_corpora.load_source(spark, corpus.source_spec("Enron"), str(tmp_path))
    assert sorted(r.message for r in df.collect()) == ["m0", "m1", "m2"]


def test_imputed_labels_are_flagged(spark):
    df = spark.createDataFrame([("b", None), ("c", "1")], "body string, label string")
    rows = corpus.unify_source(df, corpus.source_spec("Ling")).collect()
    assert [(r.label, r.label_imputed) for r in rows] == [(0, True), (1, False)]
    custom = corpus.SourceSpec("X", "x.csv", parse=lambda d: d.select(F.lit(5).alias("n")))
    assert corpus.unify_source(df, custom).columns == ["n"]


def copies(spark, n=400):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        body = "hot" if i % 3 == 0 else f"mail {rng.randrange(150)}"
        rows.append((i, rng.choice(["Enron", "CEAS_08", "other"]), "s", body, i % 2))
    df = spark.createDataFrame(
        rows, "msg_id int, dataset_source string, subject string, body string, label int"
    )
    return rows, corpus.with_content_hash(df)


def test_dedup_keeps_the_best_copy_of_every_hash(spark):
    rows, df = copies(spark)
    rank = {"CEAS_08": 0, "Enron": 1, "other": 7}
    best = {}
    for r in sorted(rows, key=lambda r: (rank[r[1]], r[0])):
        best.setdefault(r[3], r[0])
    once = corpus.dedup_by_hash(df)
    assert {r.body: r.msg_id for r in once.collect()} == best
    assert corpus.dedup_by_hash(once).count() == len(best)
    # copies are reduced in every task before they are shuffled
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") >= 1


def test_splits(spark):
    df = spark.range(4000).select(
        F.md5(F.col("id").cast("string")).alias("content_hash"),
        (F.col("id") % 4 == 0).cast("int").alias("label"),
    )
    hashed = corpus.stratified_split(df)
    assert hashed.count() == 4000
    shares = {(r.split, r.label): r.n for r in corpus.class_balance(hashed).collect()}
    for label, size in ((0, 3000), (1, 1000)):
        assert shares["train", label] / size == pytest.approx(0.70, abs=0.05)
        assert shares["val", label] / size == pytest.approx(0.15, abs=0.05)
    exact = corpus.stratified_split_exact(df, SplitParams(buckets=50))
    counts = {(r.split, r.label): r["count"] for r in exact.groupBy("split", "label").count().collect()}
    assert counts == {("train", 0): 2100, ("val", 0): 450, ("test", 0): 450,
                      ("train", 1): 700, ("val", 1): 150, ("test", 1): 150}
    assert exact.select("content_hash").distinct().count() == 4000


def test_save_unified_is_idempotent(spark, tmp_path):
    _, df = copies(spark, 30)
    path = str(tmp_path / "unified")
    tables.save_unified(df, path, partition_by=("dataset_source",))
    tables.save_unified(df.limit(1), path)
    assert spark.read.parquet(path).count() == 30
    only = tables.only_sources(spark.read.parquet(path), ["Enron"])
    assert "PartitionFilters: [" in only._jdf.queryExecution().executedPlan().toString()
    tables.save_unified(df.limit(1), path, force=True)
    assert spark.read.parquet(path).count() == 1


def test_split_loading_checks_columns(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "subject string, label long").write.parquet(str(tmp_path / "s"))
    with pytest.raises(ValueError, match="body"):
        tables.load_split(spark, str(tmp_path / "s"), "train")


def test_request_validation(spark):
    rows = [("s", "ok", "x"), (None, "ok", None), ("s", None, "x"), ("s", "  \n", "x"),
            ("s" * 11, "ok", "x"), ("s", "b" * 21, "x"), ("s", "ok", "x" * 6)]
    df = spark.createDataFrame(rows, "subject string, body string, sender string")
    limits = RequestLimits(subject=10, body=20, sender=5)
    good, bad = requests.split_requests(df, limits)
    assert good.count() == 2
    assert sorted(r.reject_reason for r in bad.collect()) == [
        "body blank", "body missing", "body too long", "sender too long", "subject too long"]


def test_summaries(spark):
    rows, df = copies(spark, 60)
    total = corpus.summary_total(df).first()
    distinct = len({r[3] for r in rows})
    assert (total.n_rows, total.n_hashes, total.n_duplicates) == (60, distinct, 60 - distinct)
    approx = corpus.summary_total(df, approximate=True).first()
    assert abs(approx.n_hashes - distinct) <= 2
    by_source = {r.dataset_source: r.n_rows for r in corpus.summary_by_source(df).collect()}
    assert by_source.pop(None) == sum(by_source.values()) == 60
    weights = {r.label: r.weight for r in corpus.class_weights(df).collect()}
    assert weights == {0: 1.0, 1: 1.0}
