import html
import re
import sys
import time
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailscreen.functions import accents, charsets, entropy, text
from mailscreen.params import TextOptions


def test_unescape_follows_html5(one):
    names = list(html.entities.html5)
    cases = [f"&{n}" for n in names] + [f"&{n}x &amp;{n}" for n in names[::7]]
    cases += [f"&#{n};" for n in range(0, 0x180)] + [f"&#x{n:x}" for n in range(0, 0x180)]
    cases += [f"&#{n};b" for n in (0xFEFF, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFE, 0x10FFFF,
                                   0x110000, 99999999999)]
    cases += ["", "&", "&&", "&;", "&#;", "&#x;", "a&b", "&notit;", "&ampamp;amp;", "&#12a",
              "& amp;", "&" + "a" * 40, "&#X000041;b", "&lt", "x &copy 2020", "&amp;lt;b&amp;gt;"]
    assert one(text.unescape, *cases) == [html.unescape(c) for c in cases]


def test_fold_agrees_with_nfkd_on_every_code_point(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame(pd.DataFrame({"id": points, "c": [chr(p) for p in points]}))
    got = df.select("id", text.ascii_fold(F.col("c")).alias("o"), text.is_blank(F.col("c")).alias("ws"))
    table = {i: (o, ws) for i, o, ws in got.toPandas().itertuples(index=False)}
    for p in points:
        folded = unicodedata.normalize("NFKD", chr(p)).encode("ascii", "ignore").decode()
        assert table[p] == (folded, chr(p).isspace()), hex(p)


def test_strip_html(one):
    cases = {
        "<p>a</p><script>x<y</script>b": "a b",
        "<STYLE>p{}</style >c</STYLE>d": "d",
        "x<!-- a\n > b -->y": "x y",
        "price < 100 and 5 > 3": "price < 100 and 5 > 3",
        "&lt;b&gt;bold&lt;/b&gt;": "bold",
        "&amp;lt;b&amp;gt;": "<b>",
        "a  \x1c b": "a b",
        "": "",
    }
    assert one(text.strip_html, *cases) == list(cases.values())


def test_clean_body_and_subject(one):
    assert one(text.clean_body, "<b>Señor\x07</b>\x0b&#8211; ﬁn ½", None, "straße") == [
        "Senor fin 12", "", "strae"
    ]
    # control characters vanish from subjects, but become blanks in bodies
    assert one(text.clean_subject, "a\x0bb\tc", None) == ["ab c", ""]
    assert one(text.clean_body, "a\x0bb\tc") == ["a b c"]


def test_cleaning_is_idempotent_on_plain_text(one):
    plain = ["Dear user,  verify now", "ação \t x", "1 < 2", ""]
    once = one(text.clean_body, *plain)
    assert one(text.clean_body, *once) == once


def test_unfolded_option_keeps_unicode(one):
    assert one(lambda c: text.clean_body(c, fold_unicode=False), "<i>é</i>  ü") == ["é ü"]
    s = ["é٣²A b!ßÉ", "日本 12", ""]
    assert one(lambda c: text.count_digits(c, False), *s) == [
        sum(ch.isdigit() for ch in t) for t in s
    ]
    assert one(lambda c: text.count_special(c, False), *s) == [
        sum(not ch.isalnum() and not ch.isspace() for ch in t) for t in s
    ]
    ratios = [
        round(sum(ch.isupper() for ch in t if ch.isalpha()) / n, 4)
        if (n := sum(ch.isalpha() for ch in t)) else 0.0
        for t in s
    ]
    assert one(lambda c: text.ratio_uppercase(c, False), *s) == ratios


def test_collapse_lines(one):
    assert one(text.collapse_ws_lines, " a \t b\n\n\n\n c\n", "x\n\ny") == ["a b\n\nc", "x\n\ny"]


def test_prepare_text(spark):
    df = spark.createDataFrame([("s", "b"), ("", "b"), ("s", "")], "s string, b string")

    def run(options):
        col = text.prepare_text(F.col("s"), F.col("b"), options)
        return [r[0] for r in df.coalesce(1).select(col).collect()]

    assert run(TextOptions()) == ["s [SEP] b", "b", "s [SEP] "]
    assert run(TextOptions(include_subject=False)) == ["b", "b", ""]
    assert run(TextOptions(max_text_length=3, separator="-")) == ["s-b", "b", "s-"]


def test_the_end_of_a_long_mail_counts(spark):
    from mailscreen.operators import features, scoring

    body = "plain words " * 2_500 + "urgent"
    df = spark.createDataFrame([(1, "", body)], "msg_id int, subject string, body string")
    prepared = features.text_corpus(df, keep=["msg_id"])
    assert len(prepared.first().prepared_text) == len(body) > 30_000
    assert scoring.HEURISTIC_TEXT.apply(prepared).first().score_text > 0


def test_tags_of_any_length(one):
    long = '<img src="data:' + "A" * 5_000 + '">'
    assert one(text.strip_tags, f"a{long}b", "a < b > c <d", "<a" * 20_000, "x>y") == [
        "a b", "a < b > c <d", "<a" * 20_000, "x>y"
    ]
    assert one(text.has_html, long, "<a" * 20_000, "1 <2> 3", "a > <b") == [True, False, False, False]


def test_term_counts_are_distinct_substrings(one):
    cases = ["URGENT urgent", "groups on Saturday", "click here now", ""]
    assert one(text.count_urgency, *cases) == [1, 0, 2, 0]
    assert one(text.count_brands, *cases) == [0, 2, 0, 0]
    assert one(text.has_urgency, *cases) == [True, False, True, False]
    # accented terms match only unfolded text, unless the lexicon is folded too
    assert one(text.count_urgency, "contraseña", "contrasena") == [1, 0]
    assert one(lambda c: text.count_urgency(c, True), "contrasena") == [1]


def test_markup_and_reply_flags(one):
    raw = ["<form>", "<FORM x", "<formula>", "<iframe src=1>", "a <b", "<9>"]
    assert one(text.has_form, *raw) == [True, True, False, False, False, False]
    assert one(text.has_iframe, *raw) == [False, False, False, True, False, False]
    assert one(text.has_html, *raw) == [True, False, True, True, False, False]
    assert one(text.is_reply_forward, "Re: x", "FWD :", " fw:", "reg: x", "x re:") == [
        True, True, True, False, False
    ]


def brute_entropy(t):
    import math
    from collections import Counter

    return abs(round(-sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()), 4)) if t else 0.0


@pytest.mark.parametrize("slice_bytes", [3, 1 << 20])
def test_entropy_kernel(monkeypatch, slice_bytes):
    import pyarrow as pa

    monkeypatch.setattr(entropy, "_SLICE_BYTES", slice_bytes)
    texts = ["", "a", "aaaa", "abcd", None, "ñandú ñ", "日本日", "x" * 50 + "y"]
    got = entropy.string_entropies(pa.array(texts))
    assert [round(float(v), 4) for v in got] == [brute_entropy(t or "") for t in texts]
    assert [round(float(v), 4) for v in entropy.string_entropies(pa.array(texts).slice(3))] == [
        brute_entropy(t or "") for t in texts[3:]
    ]
    lists = pa.array([["ab", "aaaa"], [], None, ["abcd"]])
    assert list(entropy._largest_entropy(lists)) == [1.0, 0.0, 0.0, 2.0]


def test_regex_class_covers_exactly_the_given_characters():
    assert charsets.regex_class("abcx") == r"[\x{61}-\x{63}\x{78}]"


def test_tokens_of_accented_text(one):
    texts = ["Été à Zürich, naïve CAFÉ ﬁne ①② x", "Ёлка й ΆΛΦΑ ни_1", "e\u0301a\u0308 a", "東京 日本語 한국", "plain text"]

    def by_hand(x):
        bare = "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
        return re.findall(r"\w\w+", bare)

    assert [list(r) for r in one(accents.accented_tokens, *texts)] == [by_hand(x) for x in texts]
    assert one(accents.accented_tokens, texts[-1]) == one(text.tokens, texts[-1])


def test_nested_class_accepts_the_same_code_points(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame(pd.DataFrame({"id": points, "c": [chr(p) for p in points]}))
    word = charsets.nested_class_where(accents._in_word)
    got = {r.id for r in df.filter(F.col("c").rlike(rf"^{word}\z")).select("id").collect()}
    assert got == {p for p in points if accents._in_word(chr(p))}
    assert charsets.nested_class([97]) == r"[[\x{61}]]"


def test_accented_tokens_of_long_texts_take_few_steps_a_character(spark):
    # a class of 700 ranges tried in turn takes some 5 us a character, 15 s here
    words = "los años перевод ab cd ef gh ij " * 100_000
    df = spark.range(1).select(F.size(accents.accented_tokens(F.lit("ü x yz"))).alias("n"))
    assert df.first().n == 1  # compiled
    long = spark.createDataFrame([(words,)], "t string")
    begun = time.monotonic()
    assert long.select(F.size(accents.accented_tokens(F.col("t"))).alias("n")).first().n == 800_000
    assert time.monotonic() - begun < 8
