import hashlib
import random
import re

import pytest

from mailscreen.llm import decontamination
from tests.llm.odd import PLAIN, clashing, empty_docs, odd_docs

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def by_hand(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (items_ := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= items_
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def found(docs, benchmark):
    out = decontamination.contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
    return sorted((tuple(r) for r in out.collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


ITEMS = [
    (1, "  ".join(PLAIN.split()[5:30])), (2, "The row of limes"), (3, None), (4, ""), (None, "one"),
    (10, "with its own number"), (5, "!!! ???"), (6, " ".join(PLAIN.upper().split()[5:30])),
    (7, "ÜBER"), (8, "中文 wörter"), (2, "limes along the road though each spring somebody asked and each time"),
]


def test_odd_documents(spark):
    docs = clashing(odd_docs(spark), "words", "window", "hit", "first", "length", "item", "rows")
    items = clashing(items_of(spark, ITEMS), "words", "window", "item")
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, items) == by_hand(pairs, ITEMS)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_of_few_words(spark, seed):
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    docs = [(i, text(draw.randrange(0, 60))) for i in range(60)]
    items = [(i, text(draw.choice([1, 4, 6, 9, 10, 11, 14]) + 3 * seed)) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(frame, items_of(spark, items)) == by_hand(docs, items)


def test_full_bit_table_only_costs_time(spark):
    params = decontamination.SpanParams(least_bits=6, most_bits=6)
    out = decontamination.contamination(odd_docs(spark), items_of(spark, ITEMS), params)
    got = sorted((r.doc_id, r.n_hit) for r in out.collect() if r.doc_id is not None)
    expected = by_hand([(r.doc_id, r.text) for r in odd_docs(spark).collect()], ITEMS)
    assert got == sorted((x[0], x[2]) for x in expected if x[0] is not None)


def test_clean_drops_the_contaminated(spark):
    docs = odd_docs(spark)
    kept = decontamination.clean(docs, items_of(spark, ITEMS[:1]))
    assert kept.columns == docs.columns
    bad = {1, 2, 3, -5}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(
        r.doc_id or 0 for r in docs.collect() if r.doc_id not in bad
    )


def test_empty_tables(spark):
    assert found(empty_docs(spark), items_of(spark, ITEMS)) == []
    none = found(odd_docs(spark), items_of(spark, []))
    assert len(none) == odd_docs(spark).count() and not any(r[5] for r in none)
