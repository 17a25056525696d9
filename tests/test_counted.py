import random
import time

import numpy as np
import pyarrow as pa

from mailscreen import lexicons as lx
from mailscreen.functions import counted
from mailscreen.operators import features
from mailscreen.params import TextOptions


def _mails(spark, n=300):
    rnd = random.Random(5)
    words = list(lx.URGENCY_TERMS + lx.BRAND_TERMS) + [
        "URGENT", "Ups!", "x", "", "Grüße", "\x07", " ", "<b>a</b>", "&amp;", "9.5 %", "_", "ur", "gent",
        "http://a.example.tk/x?url=http://b.example/9", "ve" * 40, "~^", "İ", "ﬁnal"]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice(["", " ", "\n"]) for _ in range(k))
    rows = [(i, text(rnd.randrange(5)), text(rnd.choice([0, 1, 3, 40, 400]))) for i in range(n)]
    rows += [(-1, None, None), (-2, "", ""), (-3, "wells", "fargo"), (-4, "x", None), (-5, "dh", "l")]
    return spark.createDataFrame(rows, "msg_id int, subject string, body string")


def test_counts_in_the_kernel_are_the_native_ones(spark):
    mails = _mails(spark)
    for options in (TextOptions(), TextOptions(fold_lexicon=True), TextOptions(fold_unicode=False)):
        frames = [features.metadata_features(mails, options, in_kernel=k) for k in (True, False)]
        assert frames[0].schema == frames[1].schema
        columns = ["msg_id", *lx.FEATURES, "subject_clean", "body_clean"]
        kernel, native = ({r.msg_id: r for r in f.select(columns).collect()} for f in frames)
        assert kernel == native
    # a term may begin in the subject and end in the body
    assert kernel[-3].brand_mention_count == 1 and kernel[-5].brand_mention_count == 0


def test_all_terms_are_found_by_one_pass():
    """60 scans a text would take longer than a few passes over it."""
    finder = counted.TermFinder(lx.URGENCY_TERMS)
    texts = ["", "no", "Verify now", "verify", "ver" + "ify" * 3, "please verify"] * 3 + ["lorem ipsum dolor " * 200_000]
    column = pa.array(texts)
    began = time.process_time()
    got = counted._terms_in(column, finder)
    took = time.process_time() - began
    assert got.tolist() == [sum(t in x.lower() for t in lx.URGENCY_TERMS) for x in texts]
    assert took < 5
    sliced = counted._terms_in(column.slice(2, 5), finder)
    assert np.array_equal(sliced, got[2:7])


def test_trained_forests_score_without_a_scan_per_term(spark):
    plan = features.metadata_features(_mails(spark, 3)).select(*lx.FEATURES)
    plan = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "urgent" not in plan and "paypal" not in plan
