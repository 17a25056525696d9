import glob
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from catalog import mail_tables, spark_queries
from mailscreen.plans import screen
from mailscreen.streaming import jobs, merged

START = datetime(2024, 1, 1)


def mails(spark, folder, n=120, files=4):
    rows = [
        (i, "s", "hot mail" if i % 3 == 0 else f"verify account {i % 40}",
         START + timedelta(minutes=i))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "msg_id int, subject string, body string, event_ts timestamp")
    # one file per slice of event time, so that batches arrive in order
    per_file = n // files
    for k in range(files):
        part = df.filter((F.col("msg_id") >= k * per_file) & (F.col("msg_id") < (k + 1) * per_file))
        part.coalesce(1).write.mode("append").parquet(folder)
    return df


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = mails(spark, folder)
    stream = jobs.read_mails(spark, folder, df.schema, max_files=1)
    keep = ["msg_id"]
    got = jobs.drain(jobs.stream_classify(stream, keep=keep))
    want = screen.classify(df, keep=keep)
    columns = ["msg_id", "label_predicted", "score_final", "score_text", "prepared_text"]
    a = sorted(map(tuple, got.select(columns).collect()))
    assert a == sorted(map(tuple, want.select(columns).collect()))
    assert len(a) == 120


def arrive(spark, folder, rows, files):
    """One file for each group of rows, in order of arrival."""
    schema = "msg_id long, subject string, body string, event_ts timestamp"
    for part in files:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, schema)


def dedup(spark, folder, schema, max_files, **settings):
    stream = jobs.read_mails(spark, folder, schema, max_files=max_files)
    slots = jobs.stream_dedup(stream, horizon="2 days", **settings)
    table, kept = merged.drain_merged(slots, jobs.FIRST, jobs.first_values(), mode="update", every=3)
    return table, sorted(r.msg_id for r in jobs.first_mails(kept, "2 days").collect())


def first_by_hand(rows):
    kept, last = [], {}
    for msg_id, subject, body, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        before = last.get((subject, body))
        if before is None or before + timedelta(days=2) < ts:
            kept.append(msg_id)
        last[(subject, body)] = ts
    return sorted(kept)


def test_first_mail_of_every_hash_whatever_the_batches(spark, tmp_path):
    draw = random.Random(8)
    rows = [
        (i, "s", f"text {draw.randrange(12)}", START + timedelta(hours=draw.randrange(24 * 20)))
        for i in range(160)
    ]
    want = first_by_hand(rows)
    assert 12 < len(want) < 160
    for n, files in enumerate((1, 6)):
        order = draw.sample(range(160), 160)
        folder = str(tmp_path / f"in{n}")
        df = arrive(spark, folder, rows, [order[k::files] for k in range(files)])
        for max_files in (1, 100):
            table, got = dedup(spark, folder, df.schema, max_files, delay="20 days")
            assert got == want
            assert table.folders(spark) <= 4


def test_copies_beyond_the_horizon(spark, tmp_path):
    # copies follow each other over three slots; then a gap of more than the horizon
    days = [0.0, 1.9, 3.7, 5.5, 7.6, 20, 22.0, 24.1]
    rows = [(i, "s", "same", START + timedelta(days=d)) for i, d in enumerate(days)]
    df = arrive(spark, str(tmp_path / "in"), rows, [[4, 0], [7, 2], [1, 6, 3], [5]])
    for max_files in (1, 4):
        _, got = dedup(spark, str(tmp_path / "in"), df.schema, max_files, delay=None)
        assert got == first_by_hand(rows) == [0, 4, 5, 7]


def test_mails_later_than_the_delay_are_ignored(spark, tmp_path):
    rows = [(1, "s", "old", START), (2, "s", "new", START + timedelta(days=30)),
            (3, "s", "newer", START + timedelta(days=31)), (4, "s", "too late", START)]
    df = arrive(spark, str(tmp_path / "in"), rows, [[0], [1], [2], [3]])
    _, got = dedup(spark, str(tmp_path / "in"), df.schema, 1, delay="2 days")
    assert got == [1, 2, 3]


KEYS = ["window_start", "window_end", "label", "gated"]


def predictions(spark, folder, schema):
    stream = jobs.read_mails(spark, folder, schema, max_files=1)
    return jobs.stream_classify(stream, keep=["msg_id", "event_ts"])


def test_counts_from_many_files_with_late_mails(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = mails(spark, folder, files=20)
    # a late file that reaches back over all windows
    df.filter("msg_id % 10 = 0").coalesce(1).write.mode("append").parquet(folder)
    events = jobs.label_events(predictions(spark, folder, df.schema), window="30 minutes")
    table, rows = merged.drain_merged(events, KEYS, [F.sum("n").alias("n")], every=4)
    rows = rows.collect()
    assert sum(r.n for r in rows) == 132
    assert {r.window_start for r in rows} == {START + timedelta(minutes=30 * k) for k in range(4)}
    assert len({(r.window_start, r.label, r.gated) for r in rows}) == len(rows)
    assert table.folders(spark) <= 5
    # a batch that runs again counts once, before and after it went into a base
    again = spark.createDataFrame([(START, START, "x", False, 5)], events.schema)
    for batch in (21, 22, 22, 23, 23, 21):
        table.add(again, batch)
    read = table.read(spark, events).filter("label = 'x'").first()
    assert read.n == 15 and table.folders(spark) <= 5


def test_stateful_counts_bound_their_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = mails(spark, folder)
    counts = jobs.stream_label_counts(predictions(spark, folder, df.schema), window="30 minutes", delay="10 minutes")
    merge = [F.max("n").alias("n")]
    _, rows = merged.drain_merged(counts, KEYS, merge, mode="update")
    assert rows.agg(F.sum("n")).first()[0] == 120


def test_merged_table_without_batches(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, n long")
    table = merged.MergedTable(str(tmp_path / "none"), ["k"], [F.sum("n").alias("n")])
    assert table.read(spark, empty).collect() == [] and table.folders(spark) == 0


def test_stream_input_has_more_files_as_it_grows(spark, sf_dir, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    seen = []
    monkeypatch.setattr(jobs, "read_mails", lambda spark, folder, schema, max_files: seen.append(
        (max_files, len(glob.glob(f"{folder}/*.parquet")))))
    for splits in (1, 10 * cores):
        monkeypatch.setattr(mail_tables, "mail_splits", lambda spark, sf, n=splits: n)
        spark_queries._arriving(spark, sf_dir, 2)
    # no file is written for a part without mails
    assert [at_once for at_once, _ in seen] == [cores, 5 * cores]
    assert seen[0][1] <= 2 * cores < seen[1][1] <= 10 * cores


def test_a_delta_of_many_keys_is_written_by_several_tasks(spark, tmp_path):
    table = merged.MergedTable(str(tmp_path / "many"), ["k"], [F.sum("n").alias("n")])
    rows = spark.range(0, 400_000, 1, 8).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as inside a stream
    try:
        table.add(rows, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(glob.glob(f"{table.path}/delta/0/*.parquet")) > 1
    assert table.read(spark, rows).agg(F.sum("n")).first()[0] == 400_000


def test_texts_are_not_shuffled_to_their_labels(spark, sf_dir, monkeypatch):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def joined():
            df = mail_tables.doc_mails(spark, sf_dir)
            plan = df._jdf.queryExecution().executedPlan().toString()
            return sorted(map(tuple, df.collect()), key=str), "SortMergeJoin" in plan

        rows, shuffled = joined()
        assert not shuffled
        monkeypatch.setattr(mail_tables, "BROADCAST_LABELS", 10)
        assert joined() == (rows, True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
