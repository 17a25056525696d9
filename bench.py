"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is computed in full into a no-op sink after one small warm-up run. The
trained-model queries train on the same data first; that time is reported separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from catalog import spark_queries as q  # noqa: E402
from mailscreen.session import tuned  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WARM_DIR = "/root/testdata/sf0.001"

HEADLINES = (
    "classify", "meta_features", "score_meta_heuristic", "prepare_text", "extract_urls",
    "url_explode", "contrib_heuristic", "threshold_sweep", "dedup_by_hash",
    "stratified_split", "summary_by_source", "eval_binary", "roc_auc", "doc_freq",
    "vocabulary", "tfidf", "stream_classify", "stream_dedup",
)
TRAINED = ("score_meta_model", "score_text_model", "classify_trained", "shap_meta")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        tuned(SparkSession.builder.master(f"local[{CPUS}]"))
        .appName("mail screening bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ui.retainedExecutions", "20")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_DIR):
        for name in ("classify", "tfidf"):
            run(q.QUERIES[name](spark, WARM_DIR))

    seconds = {n: timed(lambda: run(q.QUERIES[n](spark, SF_DIR))) for n in HEADLINES}
    training = {
        "train_meta": timed(lambda: q.meta_model(spark, SF_DIR)),
        "train_text": timed(lambda: q.text_model(spark, SF_DIR)),
    }
    seconds |= {n: timed(lambda: run(q.QUERIES[n](spark, SF_DIR))) for n in TRAINED}
    n_mails = q.mails(spark, SF_DIR).count()
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline mail-screening queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "training_sec": training,
                "mails": n_mails,
                "classify_mails_per_sec": round(n_mails / seconds["classify"], 1),
                "classify_ms_per_mail": round(1000 * seconds["classify"] / n_mails, 4),
                "cpus": int(CPUS),
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
