import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.operators import features, forest, metrics, shap, textmodel, tfidf
from mailscreen.params import ForestParams, TextModelParams
from mailscreen.plans import screen, train
from mailscreen.sources import models

RNG = random.Random(3)
WORDS = "urgent verify account prize meeting lunch report agenda bank invoice team notes".split()


def sample(n):
    rows = []
    for i in range(n):
        label = i % 3 == 0
        pool = WORDS[:4] + WORDS[8:10] if label else WORDS[4:8] + WORDS[10:]
        words = [RNG.choice(pool) for _ in range(RNG.randrange(3, 15))] + [RNG.choice(WORDS)]
        link = " http://10.0.0.1/x" if label and i % 2 else ""
        rows.append((i, "", " ".join(words) + link, int(label)))
    return rows


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(sample(240), "msg_id int, subject string, body string, label int").cache()


@pytest.fixture(scope="module")
def meta(spark, mails):
    table = forest.feature_table(features.metadata_features(mails, keep=["label"]))
    return forest.train_meta(table, ForestParams(num_trees=6, max_depth=4)), table


@pytest.fixture(scope="module")
def text(mails):
    return textmodel.train_text(features.text_corpus(mails, keep=["label"]))


# ---------------------------------------------------------------- metrics


def test_metrics_against_brute_force(spark):
    rng = random.Random(5)
    # a third of all rows share one score
    pairs = [(rng.randrange(2), 0.4 if i % 3 == 0 else rng.random()) for i in range(900)]
    df = spark.createDataFrame(pairs, "label int, score double")
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    for buckets in (2, 7, 512):
        row = metrics.roc_auc(df, "score", buckets).first()
        assert row.roc_auc == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)
        assert (row.n_positive, row.n_negative) == (len(pos), len(neg))
    assert math.isnan(metrics.roc_auc(df.filter("label = 1"), "score").first().roc_auc)

    predicted = metrics.with_prediction(df, "score")
    c = Counter((y, int(s >= 0.5)) for y, s in pairs)
    got = metrics.confusion(predicted).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (c[1, 1], c[0, 1], c[1, 0], c[0, 0])
    e = metrics.eval_binary(predicted).first()
    p, r = c[1, 1] / (c[1, 1] + c[0, 1]), c[1, 1] / (c[1, 1] + c[1, 0])
    assert (e.precision, e.recall, e.f1) == pytest.approx((p, r, 2 * p * r / (p + r)))
    report = {x["class"]: x for x in metrics.class_report(predicted).collect()}
    assert report["phishing"].support + report["legitimate"].support == 900
    assert report["accuracy"].f1 == pytest.approx((c[1, 1] + c[0, 0]) / 900)
    assert not metrics.recall_gate(predicted).first().passed


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    e = metrics.eval_binary(df).first()
    assert (e.precision, e.recall, e.f1) == (0.0, 0.0, 0.0)
    assert [r["class"] for r in metrics.class_report(df).collect()] == [
        "legitimate", "accuracy", "macro avg", "weighted avg"]


# ---------------------------------------------------------------- TF-IDF


def brute_grams(t, low, high):
    import re

    words = re.findall("[a-z0-9_]{2,}", t.lower())
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 2), (1, 3), (2, 3)])
def test_ngrams_and_counts(spark, low, high):
    texts = ["a bb cc a bb", "", "x", "one", "Aa aa AA aa", "to be or not to be or not"]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, prepared_text string")
    params = TextModelParams(ngram_min=low, ngram_max=high)
    grams = df.select("msg_id", tfidf.mail_grams(F.col("prepared_text"), params).alias("g"))
    for r in grams.collect():
        assert Counter(r.g) == Counter(brute_grams(texts[r.msg_id], low, high))
    counted = {(r.msg_id, r.term): r.tf for r in tfidf.term_freq(df, params=params).collect()}
    assert counted == {
        (i, g): n for i, t in enumerate(texts) for g, n in Counter(brute_grams(t, low, high)).items()
    }


def test_tfidf_against_brute_force(mails):
    corpus = features.text_corpus(mails, keep=["msg_id"])
    texts = {r.msg_id: r.prepared_text for r in corpus.collect()}
    params = TextModelParams(max_features=40, min_df=3)
    docs = {i: Counter(brute_grams(t, 1, 2)) for i, t in texts.items()}
    df, total = Counter(), Counter()
    for d in docs.values():
        df.update(d.keys())
        total.update(d)
    vocab = sorted((t for t in df if df[t] >= 3), key=lambda t: (-total[t], t))[:40]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}
    expected = {}
    for i, d in docs.items():
        w = {t: (1 + math.log(d[t])) * idf[t] for t in vocab if t in d}
        norm = math.sqrt(sum(v * v for v in w.values()))
        expected |= {(i, t): v / norm for t, v in w.items()}
    model = tfidf.fit(corpus, params)
    assert model.terms == tuple(sorted(vocab))
    got = {(r.msg_id, r.term): r.weight for r in model.long(corpus).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-12) for k in got)


# ---------------------------------------------------------------- text model


def test_text_model(spark, mails, text):
    corpus = features.text_corpus(mails, keep=["msg_id", "label"])
    scored = text.score(corpus)
    assert metrics.roc_auc(scored, "score_text").first().roc_auc > 0.95
    assert metrics.smoke_scores(scored, "score_text").first().valid
    top = text.top_tokens(spark, 3).collect()
    assert [r["class"] for r in top] == ["phishing"] * 3 + ["legitimate"] * 3
    assert top[0].coefficient == max(text.coefficients)
    assert top[3].coefficient == min(text.coefficients)
    blank = spark.createDataFrame([(1, " ")], "msg_id int, prepared_text string")
    assert text.score(blank).first().score_text == 0.0


def test_optimum_of_the_balanced_penalised_loss(mails, text):
    """The gradient of the weighted mean loss plus penalty vanishes at the solution."""
    corpus = features.text_corpus(mails, keep=["msg_id", "label"])
    n = len(text.tfidf.terms)
    grad, grad_b, weights = np.zeros(n), 0.0, {}
    rows = text.tfidf.weigh(corpus).collect()
    sizes = Counter(r.label for r in rows)
    w = np.array(text.coefficients)
    for r in rows:
        x = np.zeros(n)
        x[r.tfidf.indices] = r.tfidf.weights
        p = 1 / (1 + math.exp(-(x @ w + text.intercept)))
        s = len(rows) / (2 * sizes[r.label])
        grad += s * (p - r.label) * x
        grad_b += s * (p - r.label)
    lam = TextModelParams().reg_param(len(rows))
    assert np.abs(grad / len(rows) + lam * w).max() < 1e-4
    assert abs(grad_b / len(rows)) < 1e-4


def test_token_contributions_add_up(mails, text):
    corpus = features.text_corpus(mails, keep=["msg_id"])
    items = text.token_contrib(corpus, 1000).groupBy("msg_id").agg(F.sum("contribution").alias("c"))
    coef = dict(zip(text.tfidf.terms, text.coefficients))
    expected = Counter()
    for r in text.tfidf.long(corpus).collect():
        expected[r.msg_id] += max(coef[r.term] * r.weight, 0.0)
    for r in items.collect():
        assert r.c == pytest.approx(expected[r.msg_id], abs=1e-9)


# ---------------------------------------------------------------- forest and SHAP


def test_forest(spark, meta):
    model, table = meta
    assert metrics.roc_auc(model.score(table), "score_meta").first().roc_auc > 0.9
    ranked = [r.importance for r in model.feature_importance(spark).collect()]
    assert len(ranked) == 32 and ranked == sorted(ranked, reverse=True)
    assert sum(ranked) == pytest.approx(1.0)
    folds = forest.fold_score(table, ForestParams(num_trees=6, max_depth=4)).first()
    assert folds.n_rows == 240 and 0.5 < folds.fold_score <= 1.0


def test_out_of_bag_score_by_hand(spark, meta):
    table = meta[1]
    params = ForestParams(num_trees=11, max_depth=4, trees_per_bag=2)
    forests = forest.bagged_forests(table, params)
    assert [f.getNumTrees for _, f in forests] == [2, 2, 2, 2, 2, 1]
    drawn = [forest.bag_count(bag, params.seed).alias(f"n{bag}") for bag, _ in forests]
    rows = features.feature_vector(table).select("label", "features", *drawn).collect()
    right = voted = 0
    for row in rows:
        votes = [0.0, 0.0]
        for bag, fitted in forests:
            if row[f"n{bag}"] == 0:
                raw = fitted.predictRaw(row.features)
                votes = [votes[0] + raw[0], votes[1] + raw[1]]
        voted += sum(votes) > 0
        right += sum(votes) > 0 and row.label == (votes[1] > votes[0])
    got = forest.oob_score(table, params).first()
    assert (got.n_rows, got.n_voted) == (240, voted)
    assert got.oob_score == pytest.approx(right / voted) and right / voted > 0.7
    # counts are Poisson with mean 1, and equal rows are drawn alike
    counts = [row[f"n{bag}"] for row in rows for bag, _ in forests]
    assert 0.7 < sum(counts) / len(counts) < 1.3 and 0.25 < counts.count(0) / len(counts) < 0.5
    assert len({(r.label, r.features, r.n0) for r in rows}) == len({(r.label, r.features) for r in rows})


def test_shap_adds_up_to_the_prediction(spark, meta):
    model, table = meta
    groups, base = shap.path_groups(shap.node_table(model.forest, spark), 6)
    rows = model.score(table).select("score_meta", *lx.FEATURES).limit(60).toPandas()
    phi = shap.shap_values(rows[list(lx.FEATURES)].to_numpy(float), groups)
    assert np.abs(phi.sum(axis=1) + base - rows.score_meta.to_numpy()).max() < 1e-9


def test_shap_against_brute_force():
    """Hand-made paths; Shapley values by enumerating every subset of features."""
    rng = np.random.default_rng(1)
    groups = []
    for depth in (1, 2, 3, 4):
        paths = 5
        feature = np.array([rng.choice(4, depth, replace=False) for _ in range(paths)])
        low = rng.uniform(-1, 0.4, (paths, depth))
        groups.append((feature, low, low + rng.uniform(0.3, 1, (paths, depth)),
                       rng.uniform(0.05, 0.95, (paths, depth)), rng.uniform(-1, 1, paths)))
    x = rng.uniform(0, 1, (7, 4))

    def value(row, known):
        total = 0.0
        for feature, low, high, share, leaf in groups:
            for p in range(len(leaf)):
                product = leaf[p]
                for i, f in enumerate(feature[p]):
                    inside = float(low[p, i] < row[f] <= high[p, i])
                    product *= inside if f in known else share[p, i]
                total += product
        return total

    expected = np.zeros((7, 4))
    for r, f in itertools.product(range(7), range(4)):
        others = [o for o in range(4) if o != f]
        for size in range(4):
            weight = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
            for subset in itertools.combinations(others, size):
                expected[r, f] += weight * (value(x[r], {*subset, f}) - value(x[r], set(subset)))
    tables = shap.pattern_tables(groups)
    some = shap.pattern_tables(groups, most=5 * (1 * 2 + 2 * 4 + 3 * 8))
    assert [t is None for t in some] == [False, False, False, True]
    for given in (None, tables, some):
        assert np.abs(shap.shap_values(x, groups, given) - expected).max() < 1e-12


def by_polynomial(hit, share):
    """Shapley factors by multiplying every path's polynomial out and dividing again."""
    depth = len(hit)
    weights = [math.factorial(k) * math.factorial(depth - 1 - k) / math.factorial(depth) for k in range(depth)]
    poly = np.zeros((depth + 1, *hit[0].shape))
    poly[0] = 1.0
    for i in range(depth):
        taken = np.where(hit[i], poly[:-1], 0.0)
        poly *= share[:, i]
        poly[1:] += taken
    for i in range(depth):
        total, carry = np.zeros(hit[i].shape), np.zeros(hit[i].shape)
        for k in range(depth - 1, -1, -1):
            carry = np.where(hit[i], poly[k + 1] - share[:, i] * carry, poly[k] / share[:, i])
            total += weights[k] * carry
        yield (hit[i] - share[:, i]) * total


def test_deep_paths_without_tables_are_worked_out_in_fewer_steps():
    rng = np.random.default_rng(2)
    for depth in range(1, 16):
        hit = [rng.random((50, 20)) < 0.5 for _ in range(depth)]
        share = rng.uniform(0.3, 1, (20, depth))
        for got, want in zip(shap._factors(hit, share), by_polynomial(hit, share)):
            assert np.abs(got - want).max() < 1e-9
    hit, share = [rng.random((100, 200)) < 0.5 for _ in range(10)], rng.uniform(0.05, 1, (200, 10))

    def seconds(factors):
        begun = time.perf_counter()
        for _ in range(10):
            list(factors(hit, share))
        return time.perf_counter() - begun

    seconds(shap._factors)
    assert min(seconds(shap._factors) for _ in range(3)) < 0.7 * min(seconds(by_polynomial) for _ in range(3))


def grown(rng, depth, held=None):
    """Paths of a random tree in order of its leaves; features come again on a path."""
    held = held or {}
    if depth == 0 or (held and rng.random() < 0.1):
        return [(held, rng.uniform(-1, 1))]
    f = int(rng.integers(12))
    low, high, share = held.get(f, (-math.inf, math.inf, 1.0))
    edge = rng.integers(1, 40) / 40
    kept = rng.uniform(0.1, 0.9)
    paths = []
    for bounds, part in (((low, min(high, edge)), kept), ((max(low, edge), high), 1 - kept)):
        paths += grown(rng, depth - 1, {**held, f: (*bounds, share * part)})
    return paths


@pytest.mark.parametrize("depth", [1, 2, 5, 9])
def test_bundles_of_paths_add_what_their_paths_do(depth):
    rng = np.random.default_rng(depth)
    trees = [grown(rng, depth) for _ in range(4)] + [[]]
    x = rng.integers(0, 41, (60, 12)) / 40  # on the edges, too
    groups = shap.by_depth([p for tree in trees for p in tree])
    expected = shap.shap_values(x, groups)
    whole = shap.plan(trees)
    assert not whole[2]
    half = shap.plan(trees, sum(t.size for _, _, t in whole[1]) // 2)
    none = shap.plan(trees, 0)
    assert not none[1]
    for planned in (whole, half, none):
        assert np.abs(shap.planned_values(x, planned) - expected).max() < 1e-12


def test_deep_forests_are_explained_in_fewer_steps():
    rng = np.random.default_rng(6)
    trees = [grown(rng, 9) for _ in range(12)]
    groups = shap.by_depth([p for tree in trees for p in tree])
    most = 20_000  # most paths have no table
    tables, planned = shap.pattern_tables(groups, most), shap.plan(trees, most)
    x = rng.random((1000, 12))

    def seconds(work):
        begun = time.perf_counter()
        work()
        return time.perf_counter() - begun

    by_path = min(seconds(lambda: shap.shap_values(x, groups, tables)) for _ in range(2))
    assert min(seconds(lambda: shap.planned_values(x, planned)) for _ in range(2)) < 0.5 * by_path


def test_classify_with_trained_models_and_explanations(spark, mails, meta, text):
    model, _ = meta
    only = F.col("score_final") >= 0.5
    out = screen.classify(
        mails, meta_scorer=model.scorer(), text_scorer=text.scorer(),
        explainer=shap.explainer(model, spark, only=only),
    )
    rows = out.collect()
    assert {r.meta_model_name for r in rows} == {model.name}
    for r in rows:
        assert (r.score_text is None) == r.gating.activated
        if not r.is_phishing:
            assert r.explanation is None
        elif r.explanation is not None:
            values = [i.value for i in r.explanation_items]
            assert values == sorted(values, reverse=True) and min(values) >= 0
            assert len(values) <= 10 and dict(r.explanation) == {
                i.feature: i.value for i in r.explanation_items}
    assert any(r.explanation for r in rows)


def test_mails_are_explained_once(spark, mails, meta):
    frame = features.metadata_features(mails, keep=["msg_id"])
    long = shap.shap_long(shap.explainer(meta[0], spark)(frame, 10))
    assert long._jdf.queryExecution().executedPlan().toString().count("[shap_udf(") == 1
    assert long.filter("rank = 1").count() > 0


def test_unreadable_forest_never_breaks_scoring(spark, mails, meta):
    class Broken:
        forest = None

    out = screen.classify(mails, meta_scorer=meta[0].scorer(), explainer=shap.explainer(Broken, spark))
    assert {r.explanation for r in out.collect()} == {None}


def test_explanations_that_fail_are_no_result(spark, meta):
    class Unreadable:
        class forest:
            getNumTrees = 6

            @staticmethod
            def write():
                raise OSError("disk full")

    with pytest.raises(OSError):
        shap.explainer(Unreadable, spark)
    nodes = shap.node_table(meta[0].forest, spark)
    with pytest.raises(ValueError, match="5 of 6 trees"):
        shap.path_groups(nodes.filter("treeID > 0"), 6)


# ---------------------------------------------------------------- persistence


def test_training_jobs_save_and_reload(spark, mails, tmp_path):
    path = str(tmp_path / "meta")
    trained = train.run_meta(spark, mails, mails, path, ForestParams(num_trees=3, max_depth=3))
    assert set(trained.train_metrics) == {"precision", "recall", "f1", "roc_auc", "oob_score"}
    again = train.run_meta(spark, mails, mails, path)
    assert again.name == trained.name
    tpath = str(tmp_path / "text")
    text = train.run_text(spark, mails, mails, tpath, TextModelParams(max_features=50))
    corpus = features.text_corpus(mails, keep=["msg_id"])
    a = {r.msg_id: r.score_text for r in text.score(corpus).collect()}
    b = {r.msg_id: r.score_text for r in models.load_text(spark, tpath).score(corpus).collect()}
    assert a == b and text.options == models.load_text(spark, tpath).options
    info = {r.kind: r for r in models.model_info(spark, [path, tpath]).collect()}
    assert info["meta"].n_features == 32 and info["text"].vocab_size == text.vocab_size


def test_loading_checks_kind_version_and_features(spark, meta, text, tmp_path, monkeypatch):
    path, tpath = str(tmp_path / "m"), str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        models.load_meta(spark, path)
    assert models.save_meta(meta[0], spark, path)
    assert not models.save_meta(meta[0], spark, path)
    models.save_text(text, spark, tpath)
    with pytest.raises(TypeError):
        models.load_meta(spark, tpath)
    with monkeypatch.context() as m:
        m.setattr(forest, "SCHEMA_VERSION", "2.0")
        with pytest.raises(ValueError, match="schema version"):
            models.load_meta(spark, path)
    with monkeypatch.context() as m:
        m.setattr(lx, "FEATURES", (*lx.FEATURES[1:], "brand_new"))
        with pytest.raises(ValueError, match=r"added \['brand_new'\], removed \['subject_length'\]"):
            models.load_meta(spark, path)
    assert models.load_meta(spark, path).name == meta[0].name


def test_model_info_names_the_heuristic_of_a_kind_without_a_model(spark, meta, text, tmp_path):
    path, tpath = str(tmp_path / "m"), str(tmp_path / "t")
    models.save_meta(meta[0], spark, path)
    models.save_text(text, spark, tpath)

    def told(*paths):
        return {(r.kind, r.name, r.is_heuristic) for r in models.model_info(spark, list(paths)).collect()}

    trained = {("meta", meta[0].name, False), ("text", text.name, False)}
    assert told(path, tpath) == trained
    assert told(path) == {("meta", meta[0].name, False), ("text", "heuristic_text_v1", True)}
    assert told(tpath) == {("meta", "heuristic_meta_v1", True), ("text", text.name, False)}
