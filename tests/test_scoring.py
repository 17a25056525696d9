import pytest
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.operators import features, heuristics, scoring
from mailscreen.params import ForestParams, ScreenParams, SplitParams, TextModelParams
from mailscreen.plans import screen

MAILS = [
    (1, "URGENT", '<form action="http://10.0.0.1/p"></form><iframe src="x"></iframe> verify paypal'),
    (2, "hello", "see you at lunch"),
    (3, None, None),
    (4, "Re: paypal", "verify your account now http://bit.ly/x?next=http://a.tk/b http://c.tk http://d.tk"),
]


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(MAILS, "msg_id int, subject string, body string")


@pytest.mark.parametrize("bad", [
    {"gate_threshold": 1.2}, {"alpha": float("nan")}, {"decision_threshold": -0.1},
    {"gate_threshold": 0.5, "decision_threshold": 0.5}, {"top_k": 0}, {"top_k": 101},
    {"top_k": 1.5},
])
def test_bad_screen_params_are_rejected(bad):
    with pytest.raises(ValueError):
        ScreenParams(**bad)


def test_other_params_are_checked():
    for build in (
        lambda: ForestParams(num_trees=0), lambda: TextModelParams(c=0),
        lambda: TextModelParams(penalty="l3"), lambda: TextModelParams(ngram_min=3),
        lambda: SplitParams(train=0.9, val=0.2),
    ):
        with pytest.raises(ValueError):
            build()
    assert TextModelParams(c=2.0).reg_param(50) == 0.01
    assert TextModelParams(penalty="none").reg_param(50) == 0.0
    assert TextModelParams(penalty="l1").elastic_net == 1.0


def expected_meta(record):
    score = 0.0
    for name, weight in lx.HEURISTIC_WEIGHTS.items():
        v = record[name]
        if isinstance(v, bool):
            v = float(v)
        elif name.startswith("ratio_"):
            v = 1.0 if v > 0.5 else v
        elif v > 1:
            v = min(v, 3) / 3
        score += weight * v
    return min(max(score, 0.0), 1.0)


def test_classify_flow(mails):
    rows = {r.msg_id: r for r in screen.classify(mails).collect()}
    assert len(rows) == 4
    for r in rows.values():
        record = r.metadata_features.asDict()
        assert list(record) == list(lx.FEATURES)
        assert r.score_meta == pytest.approx(expected_meta(record), abs=1e-6)
        assert 0 <= r.score_final <= 1
        assert r.is_phishing == (r.label_predicted == "phishing") == (r.score_final >= 0.5)
        assert r.explanation is None
    gated, plain, empty, multi = rows[1], rows[2], rows[3], rows[4]
    assert gated.gating.activated and gated.score_text is None and gated.prepared_text == ""
    assert gated.score_final == gated.score_meta and gated.text_model_name is None
    assert not plain.gating.activated and plain.prepared_text == "hello [SEP] see you at lunch"
    assert plain.score_final == pytest.approx(0.6 * plain.score_meta + 0.4 * plain.score_text, abs=1e-6)
    assert empty.score_text == 0.0 and empty.metadata_features.subject_is_empty
    assert multi.metadata_features.num_suspicious_tlds == 3
    assert multi.metadata_features.num_urls == 4


def test_text_heuristic(spark):
    df = spark.createDataFrame(
        [("",), ("  ",), ("word " * 99 + "urgent",), ("urgent verify now",), ("plain words",)],
        "prepared_text string",
    ).coalesce(1)
    got = [r.score_text for r in scoring.HEURISTIC_TEXT.apply(df).collect()]
    assert got == pytest.approx([0.0, 0.0, 0.01 / 0.02 * 0.6 + 0.1, 0.6 + 0.3, 0.0])


def test_screening_needs_no_shuffle(mails):
    plan = screen.classify(mails)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_lean_output_skips_the_entropy_stage(mails):
    lean = screen.classify(mails).select("msg_id", "score_final")
    assert "ArrowEvalPython" not in lean._jdf.queryExecution().executedPlan().toString()


def test_filter_on_a_score_does_not_repeat_the_cleaning(mails):
    kept = screen.classify(mails).filter("score_final >= 0.5")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    whole = screen.classify(mails)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 1.2 * len(whole)
    assert {r.msg_id for r in kept.collect()} >= {1}


def test_custom_scorer_is_clipped_and_checked(mails):
    wild = scoring.Scorer("wild", lambda df: df.withColumn("score_meta", F.lit(7.0)))
    assert {r.score_meta for r in screen.classify(mails, meta_scorer=wild).collect()} == {1.0}
    with pytest.raises(ValueError):
        screen.classify(mails, meta_scorer=scoring.Scorer("none", lambda df: df))
    with pytest.raises(TypeError):
        screen.classify(mails, text_scorer="no scorer")


def test_response_warns_about_heuristics(mails):
    out = screen.response(screen.classify(mails), ["msg_id"])
    assert out.first().warning == screen.HEURISTIC_WARNING
    trained = scoring.Scorer("t", scoring.HEURISTIC_META.apply)
    text = scoring.Scorer("u", scoring.HEURISTIC_TEXT.apply)
    assert screen.response(screen.classify(mails), ["msg_id"], trained, text).first().warning is None


def test_contributions_sum_to_the_score(mails):
    frame = features.metadata_features(mails, keep=["msg_id"])
    rows = heuristics.explain_heuristic(frame, 13, ["msg_id"]).collect()
    scores = {r.msg_id: r.score_meta for r in scoring.HEURISTIC_META.apply(frame).collect()}
    for i, score in scores.items():
        mine = sorted((r for r in rows if r.msg_id == i), key=lambda r: r.rank)
        assert [r.value for r in mine] == sorted((r.value for r in mine), reverse=True)
        assert min(sum(r.value for r in mine), 1.0) == pytest.approx(score, abs=1e-5)
    assert max(r.rank for r in heuristics.explain_heuristic(frame, 2, ["msg_id"]).collect()) == 2


def test_feature_vector_fills_missing_and_keeps_order(mails):
    frame = features.metadata_features(mails, keep=["msg_id"]).drop("has_form")
    v = features.feature_vector(frame).filter("msg_id = 1").first().features
    assert v.size == 32
    assert v[lx.FEATURES.index("has_form")] == 0.0
    assert v[lx.FEATURES.index("has_iframe")] == 1.0


def test_where_reaches_the_scan(spark, tmp_path):
    folder = str(tmp_path / "mails")
    rows = [(i, "a" if i % 2 else "b", "hello", f"verify account {i}") for i in range(20)]
    frame = spark.createDataFrame(rows, "msg_id long, dataset_source string, subject string, body string")
    frame.write.partitionBy("dataset_source").parquet(folder)
    mails = spark.read.parquet(folder)
    picked = screen.classify(mails, where="dataset_source = 'a' and msg_id > 10")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "(dataset_source" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThan(msg_id,10)" in scan.split("PushedFilters: [")[1]
    later = screen.classify(mails).filter("dataset_source = 'a' and msg_id > 10")
    assert sorted(map(str, picked.collect())) == sorted(map(str, later.collect()))
    assert picked.count() == 5
