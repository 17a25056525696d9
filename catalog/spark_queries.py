"""Registered queries: every operator over the given tables, as (spark, folder) -> frame."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import mail_tables
from mailscreen import lexicons as lx
from mailscreen.functions import accents, entropy, text, urls
from mailscreen.operators import (
    corpus, features, forest, heuristics, metrics, scoring, shap, textmodel, tfidf,
)
from mailscreen.params import ScreenParams, SplitParams
from mailscreen.plans import screen
from mailscreen.session import work_folder
from mailscreen.sources import csv_corpora, models, requests, tables
from mailscreen.streaming import jobs, merged

SWEEP_GRID = tuple(
    ScreenParams(gate_threshold=g, alpha=a, decision_threshold=d)
    for g in (0.6, 0.7, 0.8) for a in (0.4, 0.6) for d in (0.3, 0.5)
)

# ---------------------------------------------------------------- inputs


def mails(spark: SparkSession, sf: str) -> DataFrame:
    return mail_tables.all_mails(spark, sf)


def doc_mails(spark: SparkSession, sf: str) -> DataFrame:
    return mail_tables.doc_mails(spark, sf)


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return features.clean_mails(mails(spark, sf), keep=["msg_id"])


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return features.text_corpus(mails(spark, sf), keep=["msg_id", "label"])


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Only documents can have a label."""
    return doc_mails(spark, sf).filter(F.col("label").isNotNull())


def prepared_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return features.text_corpus(labelled(spark, sf), keep=["msg_id", "label"])


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled mails with heuristic score and prediction."""
    stages = screen.score_stages(labelled(spark, sf), keep=["msg_id", "label"])
    final = stages.select("msg_id", "label", F.col("score_final").alias("score"))
    return metrics.with_prediction(final, "score")


def corpus_frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The seven corpora in their own column shapes, derived from the given tables."""
    return {
        name: mail_tables.corpus_frame(spark, sf, name) for name in mail_tables.CORPUS_SHAPES
    }


def unified(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unify_corpora(corpus_frames(spark, sf), keep=("msg_id",))


def unique(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.dedup_by_hash(unified(spark, sf).drop("subject", "body"))


# ---------------------------------------------------------------- shared models


def _app(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


@lru_cache(maxsize=4)
def _meta_model(app: str, sf: str) -> forest.ForestModel:
    spark = SparkSession.getActiveSession()
    return forest.train_meta(_feature_table(app, sf))


@lru_cache(maxsize=4)
def _feature_table(app: str, sf: str) -> DataFrame:
    spark = SparkSession.getActiveSession()
    return forest.feature_table(
        features.metadata_features(labelled(spark, sf), keep=["label"])
    )


@lru_cache(maxsize=4)
def _text_model(app: str, sf: str) -> textmodel.TextModel:
    spark = SparkSession.getActiveSession()
    return textmodel.train_text(prepared_labelled(spark, sf))


def meta_model(spark: SparkSession, sf: str) -> forest.ForestModel:
    return _meta_model(_app(spark), sf)


def text_model(spark: SparkSession, sf: str) -> textmodel.TextModel:
    return _text_model(_app(spark), sf)


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return _feature_table(_app(spark), sf)


# ---------------------------------------------------------------- sources and sinks


def _csv_corpus(spark, sf):
    """A corpus as part files: two column orders, one file in Latin-1, malformed lines."""
    folder = work_folder(spark, "csv")
    spec = corpus.source_spec("CEAS_08")
    frame = mail_tables.corpus_frame(spark, sf, "CEAS_08")
    latin = F.col("body").rlike(r"^[\x00-\xFF]*\z") & F.col("subject").rlike(r"^[\x00-\xFF]*\z")
    latin = latin & ~F.col("body").rlike(r"^[\x00-\x7F]*\z")

    def put(rows, *columns, encoding="UTF-8"):
        (
            rows.select(*columns).write.mode("append").option("header", True)
            .option("escape", '"').option("quoteAll", True).option("encoding", encoding)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{folder}/{spec.filename}")
        )

    put(frame.filter(~latin & (F.col("msg_id") % 4 == 0)), "msg_id", "subject", "body", "label")
    put(frame.filter(~latin & (F.col("msg_id") % 4 != 0)), "label", "body", "msg_id", "subject")
    put(frame.filter(latin), "msg_id", "subject", "body", "label", encoding="ISO-8859-1")
    lines = frame.filter(F.col("msg_id") % 10 == 0).select(
        F.concat(F.col("msg_id"), F.lit(",a,b,0,one cell too many")).alias("value")
    )
    header = spark.createDataFrame([("msg_id,subject,body,label",)], "value string").coalesce(1)
    header.union(lines.coalesce(1)).coalesce(1).write.mode("append").text(f"{folder}/{spec.filename}")
    return csv_corpora.load_parts(spark, spec, folder)


def src_csv(spark, sf):
    raw, _ = _csv_corpus(spark, sf)
    return raw.select(F.col("msg_id").cast("bigint"), "subject", "body", "label")


def src_csv_rejects(spark, sf):
    """The rows that do not fit their header."""
    _, malformed = _csv_corpus(spark, sf)
    return malformed.select(
        F.get("cells", F.lit(0)).cast("bigint").alias("msg_id"),
        F.size("cells").alias("n_cells"), F.element_at("cells", -1).alias("surplus"),
    )


def src_registry(spark, sf):
    wanted = [s.name for s in corpus.select_sources(["CEAS_08", "Nazario"])]
    return (
        tables.only_sources(unified(spark, sf), wanted)
        .groupBy("dataset_source").agg(F.count("*").alias("n_rows"))
    )


def src_parquet_split(spark, sf):
    path = work_folder(spark, "split")
    labelled(spark, sf).write.parquet(path)
    return tables.load_split(spark, path, "train", columns=("msg_id",))


def sink_parquet(spark, sf):
    path = work_folder(spark, "unified")
    table = unified(spark, sf)
    tables.save_unified(table, path)
    # an existing table is left alone
    tables.save_unified(table.limit(0), path)
    return spark.read.parquet(path).select(
        "msg_id", "dataset_source", "content_hash", F.col("label").cast("int").alias("label")
    )


def sink_model(spark, sf):
    path = work_folder(spark, "models")
    models.save_meta(meta_model(spark, sf), spark, f"{path}/meta")
    return models.manifest(spark, f"{path}/meta").select(
        "kind", "schema_version", "estimator", F.size("feature_names").alias("n_features")
    )


def src_model(spark, sf):
    path = work_folder(spark, "models")
    models.save_text(text_model(spark, sf), spark, f"{path}/text")
    loaded = models.load_text(spark, f"{path}/text")
    return loaded.score(prepared(spark, sf)).select(
        "msg_id", F.round("score_text", 6).alias("score_text")
    )


def model_info(spark, sf):
    path = work_folder(spark, "models")
    models.save_meta(meta_model(spark, sf), spark, f"{path}/meta")
    models.save_text(text_model(spark, sf), spark, f"{path}/text")
    return models.model_info(spark, [f"{path}/meta", f"{path}/text"])


def src_request(spark, sf):
    handed_in = mails(spark, sf).withColumn("sender", F.col("dataset_source"))
    return requests.validate(handed_in).select("msg_id", "reject_reason")


def sink_scores(spark, sf):
    path = work_folder(spark, "scores")
    predictions = screen.classify(mails(spark, sf), keep=["msg_id"], in_kernel=True)
    answers = screen.response(predictions, ["msg_id"])
    schema = answers.schema
    tables.save_scores(answers, path, "json")
    return spark.read.schema(schema).json(path).select(
        "msg_id", "label", "is_phishing", "score_final", "score_meta", "score_text",
        F.col("gating.activated").alias("gated"), F.col("gating.threshold").alias("threshold"),
        F.col("metadata_features.num_urls").alias("num_urls"),
        F.col("warning").isNotNull().alias("has_warning"),
    )


# ---------------------------------------------------------------- unification


def pick_column(spark, sf):
    df = mail_tables.corpus_frame(spark, sf, "Enron")
    spec = corpus.source_spec("Enron")
    return df.select(
        "msg_id",
        corpus.pick_column(df, spec.body).alias("body"),
        corpus.pick_column(df, ("absent",), "none").alias("absent"),
    )


def unify_schema(spark, sf):
    df = mail_tables.corpus_frame(spark, sf, "CEAS_08")
    return corpus.unify_schema(
        df, "any", ("subject",), ("content", "body"), ("absent",), keep=("msg_id",)
    ).withColumn("label", F.col("label").cast("int"))


def unify(name: str):
    def query(spark, sf):
        df = mail_tables.corpus_frame(spark, sf, name)
        mapped = corpus.unify_source(df, corpus.source_spec(name), keep=("msg_id",))
        return mapped.withColumn("label", F.col("label").cast("int"))

    return query


def label_coerce(spark, sf):
    raw = mail_tables.raw_labels(spark, sf)
    return raw.select(
        "doc_id", "raw",
        F.coalesce(corpus.label_coerce(F.col("raw")).cast("int"), F.lit(-1)).alias("label"),
    )


def drop_bad_sources(spark, sf):
    good = unify("CEAS_08")(spark, sf)
    bad = corpus.unify_source(
        mail_tables.corpus_frame(spark, sf, "Enron_bad"), corpus.source_spec("Enron"), ("msg_id",)
    ).withColumn("label", F.col("label").cast("int"))
    kept = corpus.drop_bad_sources(good.unionByName(bad))
    return kept.select("msg_id", "dataset_source", "label")


def schema_check(spark, sf):
    checked = corpus.require_columns(unified(spark, sf), lx.UNIFIED_COLUMNS, "the unified table")
    return checked.groupBy("dataset_source", F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n_rows")
    )


def filter_empty(spark, sf):
    half_blank = mail_tables.blanked(spark, sf)
    return corpus.filter_empty(half_blank).select("msg_id", "subject", "body")


def content_hash(spark, sf):
    df = mail_tables.blanked(spark, sf)
    return df.select(
        "msg_id", corpus.content_hash(F.col("subject"), F.col("body")).alias("content_hash")
    )


def union_all(spark, sf):
    mapped = [unify(n)(spark, sf) for n in mail_tables.CORPUS_SHAPES]
    return corpus.union_all(mapped).select("msg_id", "dataset_source", "label")


def order_cast_columns(spark, sf):
    table = corpus.order_cast(
        corpus.with_content_hash(unify("CEAS_08")(spark, sf)), keep=("msg_id",)
    )
    return table.withColumn("label", F.col("label").cast("int"))


def dedup_by_hash(spark, sf):
    return unique(spark, sf).select(
        "msg_id", "dataset_source", F.col("label").cast("int").alias("label"), "content_hash"
    )


def stratified_split(spark, sf):
    split = corpus.stratified_split(unique(spark, sf))
    return split.select("content_hash", F.col("label").cast("int").alias("label"), "split")


def stratified_split_exact(spark, sf):
    split = corpus.stratified_split_exact(unique(spark, sf))
    return split.select("content_hash", F.col("label").cast("int").alias("label"), "split")


# ---------------------------------------------------------------- scalar functions


def over_mails(build, column: str = "body"):
    def query(spark, sf):
        df = mails(spark, sf)
        return df.select("msg_id", build(F.coalesce(F.col(column), F.lit(""))).alias("result"))

    return query


def over_clean(build):
    def query(spark, sf):
        return cleaned(spark, sf).select("msg_id", build().alias("result"))

    return query


def noisy(build):
    """Over texts with control characters and mixed white space worked in."""
    def query(spark, sf):
        df = mails(spark, sf).select("msg_id", F.expr(mail_tables.NOISY).alias("noisy"))
        return df.select("msg_id", build(F.col("noisy")).alias("result"))

    return query


def is_reply_forward(spark, sf):
    marked = F.concat(F.expr(mail_tables.REPLY_PREFIX), F.col("subject_clean"))
    return cleaned(spark, sf).select("msg_id", text.is_reply_forward(marked).alias("result"))


def both() -> Column:
    return F.concat("subject_clean", F.lit(" "), "body_clean")


body, subject = "body_clean", "subject_clean"


def prepare_text(spark, sf):
    return features.text_corpus(mails(spark, sf), keep=["msg_id"])


def extract_urls(spark, sf):
    return mails(spark, sf).select(
        "msg_id", F.array_join(urls.extract_urls(F.col("body")), " ").alias("result")
    )


def clean_url(spark, sf):
    found = mails(spark, sf).select(
        "msg_id", F.posexplode(F.regexp_extract_all("body", F.lit(lx.URL), F.lit(0)))
        .alias("pos", "raw"),
    )
    return found.select("msg_id", "pos", "raw", urls.clean_url(F.col("raw")).alias("url"))


def nested_urls(spark, sf):
    """Targets carried by the URLs that stand in the text, one level deep."""
    raw = mails(spark, sf).select("msg_id", F.coalesce("body", F.lit("")).alias("raw"))
    decoded = raw.select("msg_id", text.unescape(F.col("raw")).alias("decoded"))
    outer = decoded.select(
        "msg_id",
        urls.outer_urls(F.col("decoded"), text.strip_unescaped_html(F.col("decoded"))).alias("urls"),
    )
    return outer.select("msg_id", F.explode(urls.nested_urls(F.col("urls"))).alias("url"))


def extract_domains(spark, sf):
    return cleaned(spark, sf).select(
        "msg_id", F.array_join(urls.extract_domains(F.col("urls")), " ").alias("result")
    )


def domains() -> Column:
    return urls.extract_domains(F.col("urls"))


def max_url_entropy(spark, sf):
    return cleaned(spark, sf).select(
        "msg_id",
        F.round(entropy.mail_entropies(F.col(subject), F.col(body), F.col("urls"))["urls"], 4)
        .alias("result"),
    )


def url_explode(spark, sf):
    one_per_url = cleaned(spark, sf).select("msg_id", F.explode("urls").alias("url"))
    return (
        one_per_url.select(
            "msg_id", "url",
            F.nullif(F.lower(F.regexp_extract("url", lx.URL_HOST, 1)), F.lit("")).alias("domain"),
        )
        .groupBy("domain")
        .agg(
            F.count("*").alias("n_urls"),
            F.count_distinct("msg_id").alias("n_mails"),
            F.max(F.length("url")).alias("max_length"),
            F.count_if(F.col("url").rlike(lx.REDIRECT_PARAM)).alias("n_redirects"),
        )
    )


# ---------------------------------------------------------------- features and scores


def meta_features(spark, sf):
    return features.metadata_features(mails(spark, sf), keep=["msg_id"]).select(
        "msg_id", *lx.FEATURES
    )


def feature_vector(spark, sf):
    from pyspark.ml.functions import vector_to_array

    frame = features.feature_vector(
        features.metadata_features(mails(spark, sf), keep=["msg_id"])
    )
    values = vector_to_array("features")
    return frame.select(
        "msg_id",
        F.size(values).alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 3).alias("total"),
        F.get(values, F.lit(5)).alias("v5"),
        F.get(values, F.lit(31)).alias("v31"),
    )


def extract_quality(spark, sf):
    return features.extract_quality(mails(spark, sf))


def stages(spark, sf, keep=("msg_id",), **kwargs):
    return screen.score_stages(mails(spark, sf), keep=list(keep), **kwargs)


def score_meta_heuristic(spark, sf):
    return stages(spark, sf).select("msg_id", F.round("score_meta", 6).alias("score_meta"))


def score_text_heuristic(spark, sf):
    frame = features.text_corpus(mails(spark, sf), keep=["msg_id"])
    return scoring.HEURISTIC_TEXT.apply(frame).select(
        "msg_id", F.round("score_text", 6).alias("score_text")
    )


def score_meta_model(spark, sf):
    frame = features.metadata_features(mails(spark, sf), keep=["msg_id"])
    return meta_model(spark, sf).score(frame).select("msg_id", "score_meta")


def score_text_model(spark, sf):
    return text_model(spark, sf).score(prepared(spark, sf)).select("msg_id", "score_text")


def gate(spark, sf):
    return stages(spark, sf).select("msg_id", "gated")


def fuse(spark, sf):
    return stages(spark, sf).select("msg_id", F.round("score_final", 6).alias("score_final"))


def label_decision(spark, sf):
    return stages(spark, sf).select(
        "msg_id",
        scoring.label_decision(F.col("score_final"), 0.5).alias("label_predicted"),
    )


def flat(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        "msg_id", "label_predicted", "is_phishing", "score_final", "score_meta", "score_text",
        F.col("gating.activated").alias("gated"),
        F.col("gating.threshold").alias("threshold"),
        "prepared_text", "meta_model_name", "text_model_name",
        *(F.col(f"metadata_features.{n}").alias(n) for n in lx.FEATURES),
    )


def classify(spark, sf):
    return flat(screen.classify(mails(spark, sf), keep=["msg_id"]))


def classify_trained(spark, sf):
    """The whole flow with both trained models and SHAP explanations."""
    meta = meta_model(spark, sf)
    predictions = screen.classify(
        mails(spark, sf), meta_scorer=meta.scorer(),
        text_scorer=text_model(spark, sf).scorer(), keep=["msg_id"],
        explainer=shap.explainer(meta, spark), in_kernel=True,
    )
    return predictions.select(
        "msg_id", "label_predicted", "score_final", "score_meta", "score_text",
        F.array_join(F.map_keys("explanation"), " ").alias("explained_by"),
    )


def ungated(spark, sf):
    """Both scores of every mail, whatever the gate."""
    frame = features.metadata_features(mails(spark, sf), keep=["msg_id", "label"])
    meta = scoring.HEURISTIC_META.apply(frame)
    prepared_text = text.prepare_text(F.col(subject), F.col(body))
    both_scores = scoring.HEURISTIC_TEXT.apply(
        meta.select("msg_id", "label", "score_meta", prepared_text.alias("prepared_text"))
    )
    return both_scores.select("msg_id", "label", "score_meta", "score_text")


def threshold_sweep(spark, sf):
    return scoring.threshold_sweep(ungated(spark, sf), SWEEP_GRID)


def custom_scorer(spark, sf):
    rate = scoring.Scorer(
        "urgency_rate",
        lambda df: df.withColumn(
            "score_text", text.count_urgency(F.col("prepared_text")) / F.lit(8.0)
        ),
    )
    predictions = screen.classify(mails(spark, sf), text_scorer=rate, keep=["msg_id"])
    return predictions.select("msg_id", "label_predicted", "score_text", "text_model_name")


def contrib_heuristic(spark, sf):
    frame = features.metadata_features(mails(spark, sf), keep=["msg_id"])
    return heuristics.explain_heuristic(frame, ScreenParams().top_k, ["msg_id"])


# ---------------------------------------------------------------- aggregation


def summary_total(spark, sf):
    return corpus.summary_total(unified(spark, sf))


def summary_by_source(spark, sf):
    return corpus.summary_by_source(unified(spark, sf))


def class_balance(spark, sf):
    split = corpus.stratified_split(unique(spark, sf))
    return corpus.class_balance(split).withColumn("label", F.col("label").cast("int"))


def class_weights(spark, sf):
    return corpus.class_weights(labelled(spark, sf).select("label")).withColumn(
        "weight", F.round("weight", 6)
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def confusion(spark, sf):
    return metrics.confusion(scored(spark, sf))


def eval_binary(spark, sf):
    return rounded(metrics.eval_binary(scored(spark, sf)), "precision", "recall", "f1")


def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(scored(spark, sf), "score"), "roc_auc")


def class_report(spark, sf):
    return rounded(metrics.class_report(scored(spark, sf)), "precision", "recall", "f1")


def recall_gate(spark, sf):
    return rounded(metrics.recall_gate(scored(spark, sf)), "recall")


def smoke_scores(spark, sf):
    return metrics.smoke_scores(scored(spark, sf), "score")


def oob_score(spark, sf):
    return forest.oob_score(feature_table(spark, sf))


def fold_score(spark, sf):
    return forest.fold_score(feature_table(spark, sf))


# ---------------------------------------------------------------- TF-IDF and models


def tokens(spark, sf):
    return prepared(spark, sf).select(
        "msg_id", F.array_join(text.tokens(F.col("prepared_text")), " ").alias("result")
    )


def ngrams(spark, sf):
    return prepared(spark, sf).select(
        "msg_id", F.array_join(tfidf.mail_grams(F.col("prepared_text")), "|").alias("result")
    )


def text_tokens_accented(spark, sf):
    """Tokens of mail texts as they came, without folding."""
    texts = doc_mails(spark, sf).select("msg_id", F.col("body").alias("result"))
    return texts.select("msg_id", F.array_join(accents.accented_tokens(F.col("result")), " ").alias("result"))


def term_freq(spark, sf):
    return tfidf.term_freq(prepared(spark, sf))


def doc_freq(spark, sf):
    return tfidf.doc_freq(prepared(spark, sf))


def vocabulary(spark, sf):
    return tfidf.vocabulary(prepared(spark, sf))


def tfidf_weights(spark, sf):
    mails_in_words = tfidf.tokenized(prepared(spark, sf), ["msg_id"])
    return rounded(tfidf.fit(mails_in_words).long(mails_in_words), "weight")


def split_mails(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by the stable bucket of the mail's id."""
    key = F.md5(F.col("msg_id").cast("string"))
    bucket = corpus.split_bucket(key)
    params = SplitParams()
    return (
        rows.filter(bucket < params.train_end),
        rows.filter((bucket >= params.train_end) & (bucket < params.val_end)),
    )


def train_text(spark, sf):
    """Figures of the text model on mails it was not trained on."""
    training, held_out = split_mails(labelled(spark, sf))
    keep = ["msg_id", "label"]
    model = textmodel.train_text(features.text_corpus(training, keep=keep))
    scores = model.score(features.text_corpus(held_out, keep=keep))
    return metrics.eval_binary(metrics.with_prediction(scores, "score_text"))


def top_tokens(spark, sf):
    return text_model(spark, sf).top_tokens(spark, 20)


def token_contrib(spark, sf):
    return text_model(spark, sf).token_contrib(prepared(spark, sf), 10)


def train_meta(spark, sf):
    """Figures of the forest on mails it was not trained on."""
    training, held_out = (
        forest.feature_table(features.metadata_features(rows, keep=["label"]))
        for rows in split_mails(labelled(spark, sf))
    )
    model = forest.train_meta(training)
    return metrics.eval_binary(metrics.with_prediction(model.score(held_out), "score_meta"))


def feature_importance(spark, sf):
    return meta_model(spark, sf).feature_importance(spark)


def shap_meta(spark, sf):
    meta = meta_model(spark, sf)
    frame = features.metadata_features(mails(spark, sf), keep=["msg_id"])
    explained = shap.explainer(meta, spark)(frame, ScreenParams().top_k)
    return shap.shap_long(explained)


# ---------------------------------------------------------------- streaming


def _arriving(spark, sf, batches):
    """Mails in files with event times in no order, to be read in so many batches.

    Files are as many as the input's splits, so their size does not grow with the input, and
    every batch has one for each core.
    """
    folder = work_folder(spark, "stream-mails")
    rows = mail_tables.with_event_time(mails(spark, sf))
    at_once = max(spark.sparkContext.defaultParallelism,
                  -(-mail_tables.mail_splits(spark, sf) // batches))
    rows.repartition(at_once * batches, "msg_id").write.parquet(folder)
    return jobs.read_mails(spark, folder, rows.schema, max_files=at_once)


def stream_classify(spark, sf):
    # part files, as a mail gateway drops them; all of them in one batch
    predictions = jobs.stream_classify(_arriving(spark, sf, 1), keep=["msg_id"])
    return flat(jobs.drain(predictions, "stream-classify"))


def stream_dedup(spark, sf):
    # event times spread over 30 days in every file
    slots = jobs.stream_dedup(_arriving(spark, sf, 2), delay="30 days")
    _, rows = merged.drain_merged(slots, jobs.FIRST, jobs.first_values(), "stream-dedup", "update")
    return jobs.first_mails(rows).select(
        "content_hash", "msg_id", F.unix_timestamp("event_ts").alias("event_ts")
    )


def stream_label_counts(spark, sf):
    predictions = jobs.stream_classify(_arriving(spark, sf, 4), keep=["msg_id", "event_ts"])
    keys = ["window_start", "window_end", "label", "gated"]
    total = [F.sum("n").alias("n")]
    _, counts = merged.drain_merged(jobs.label_events(predictions), keys, total, "stream-counts")
    return counts.select(
        F.unix_timestamp("window_start").alias("window_start"), "label", "gated", "n"
    )


QUERIES = {
    "src_csv": src_csv,
    "src_csv_rejects": src_csv_rejects,
    "src_registry": src_registry,
    "src_parquet_split": src_parquet_split,
    "sink_parquet": sink_parquet,
    "sink_model": sink_model,
    "src_model": src_model,
    "model_info": model_info,
    "src_request": src_request,
    "sink_scores": sink_scores,
    "pick_column": pick_column,
    "unify_schema": unify_schema,
    "unify_ceas08": unify("CEAS_08"),
    "unify_enron": unify("Enron"),
    "unify_ling": unify("Ling"),
    "unify_nazario": unify("Nazario"),
    "unify_nigerian": unify("Nigerian_Fraud"),
    "unify_phishing_email": unify("phishing_email"),
    "unify_spamassassin": unify("SpamAssasin"),
    "label_coerce": label_coerce,
    "drop_bad_sources": drop_bad_sources,
    "schema_check": schema_check,
    "filter_empty": filter_empty,
    "content_hash": content_hash,
    "union_all": union_all,
    "order_cast_columns": order_cast_columns,
    "dedup_by_hash": dedup_by_hash,
    "stratified_split": stratified_split,
    "stratified_split_exact": stratified_split_exact,
    "html_unescape": over_mails(text.unescape),
    "strip_style_script": over_mails(text.strip_style_script),
    "strip_comments": over_mails(text.strip_comments),
    "strip_tags": over_mails(text.strip_tags),
    "strip_html": over_mails(text.strip_html),
    "ascii_fold": over_mails(text.ascii_fold),
    "strip_control": noisy(text.strip_control),
    "collapse_ws": noisy(text.collapse_ws),
    "collapse_ws_lines": noisy(text.collapse_ws_lines),
    "clean_body": over_mails(text.clean_body),
    "clean_subject": over_mails(text.clean_subject, "subject"),
    "prepare_text": prepare_text,
    "has_urgency": over_clean(lambda: text.has_urgency(both())),
    "count_urgency": over_clean(lambda: text.count_urgency(both())),
    "count_brands": over_clean(lambda: text.count_brands(both())),
    "shannon_entropy": over_clean(lambda: entropy.shannon_entropy(F.col(body))),
    "count_digits": over_clean(lambda: text.count_digits(F.col(body))),
    "count_special": over_clean(lambda: text.count_special(F.col(body))),
    "ratio_uppercase": over_clean(lambda: text.ratio_uppercase(F.col(body))),
    "count_exclaim": over_clean(lambda: text.count_exclaim(F.col(body))),
    "has_html": over_mails(text.has_html),
    "has_form": over_mails(text.has_form),
    "has_iframe": over_mails(text.has_iframe),
    "is_reply_forward": is_reply_forward,
    "text_token_pattern": over_clean(lambda: F.array_join(text.tokens(F.col(body)), " ")),
    "text_tokens_accented": text_tokens_accented,
    "extract_urls": extract_urls,
    "clean_url": clean_url,
    "nested_urls": nested_urls,
    "extract_domains": extract_domains,
    "has_ip_url": over_clean(lambda: urls.has_ip_url(F.col("urls"))),
    "has_shortener": over_clean(lambda: urls.has_shortener(domains())),
    "count_susp_tlds": over_clean(lambda: urls.count_risky_tlds(domains())),
    "max_url_entropy": max_url_entropy,
    "avg_url_length": over_clean(lambda: urls.avg_url_length(F.col("urls"))),
    "max_url_length": over_clean(lambda: urls.max_url_length(F.col("urls"))),
    "count_redirects": over_clean(lambda: urls.count_redirects(F.col("urls"))),
    "url_explode": url_explode,
    "meta_features": meta_features,
    "feature_vector": feature_vector,
    "extract_quality": extract_quality,
    "score_meta_heuristic": score_meta_heuristic,
    "score_text_heuristic": score_text_heuristic,
    "score_meta_model": score_meta_model,
    "score_text_model": score_text_model,
    "gate": gate,
    "fuse": fuse,
    "label_decision": label_decision,
    "classify": classify,
    "classify_trained": classify_trained,
    "threshold_sweep": threshold_sweep,
    "custom_scorer": custom_scorer,
    "contrib_heuristic": contrib_heuristic,
    "summary_total": summary_total,
    "summary_by_source": summary_by_source,
    "class_balance": class_balance,
    "class_weights": class_weights,
    "confusion": confusion,
    "eval_binary": eval_binary,
    "roc_auc": roc_auc,
    "class_report": class_report,
    "recall_gate": recall_gate,
    "smoke_scores": smoke_scores,
    "oob_score": oob_score,
    "fold_score": fold_score,
    "tokens": tokens,
    "ngrams": ngrams,
    "term_freq": term_freq,
    "doc_freq": doc_freq,
    "vocabulary": vocabulary,
    "tfidf": tfidf_weights,
    "train_text": train_text,
    "top_tokens": top_tokens,
    "token_contrib": token_contrib,
    "train_meta": train_meta,
    "feature_importance": feature_importance,
    "shap_meta": shap_meta,
    "stream_classify": stream_classify,
    "stream_dedup": stream_dedup,
    "stream_label_counts": stream_label_counts,
}
