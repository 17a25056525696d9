"""License templates against regular expressions, and phrases against a plain search."""

import random
import re

import pytest

from mailscreen.llm import license_scan, license_templates
from mailscreen.llm.duck_sql import template_regex
from tests.llm.odd import clashing, empty_docs, odd_docs, rows_of

SCANNER = license_scan.Scanner(
    license_templates.PHRASES, license_templates.TEMPLATES, license_templates.SPELLINGS
)


def labels(text):
    _, found = SCANNER(text.encode())
    return sorted({m.label for m in found if not m.phrase})


def test_notices():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2"]
    assert labels("Released under the MIT Licence") == ["mit"]
    assert labels("licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("Available under GPL v2.0 only") == ["gpl-2"]
    assert labels("Shared under a Creative Commons Attribution-ShareAlike 4.0 licence") == ["cc-by-sa"]
    assert labels("licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa"]
    # mandatory wording that differs, or is cut off, is not accepted
    assert labels("Licensed under the Apache Licence, Version 3.0.") == []
    assert labels("licensed under CC BY") == []
    assert labels("The MIT people licensed under protest") == []


def test_whole_texts_with_optional_and_replaceable_regions():
    mit = license_templates.TEMPLATES[0][1][1]
    full = re.sub(r"\{\{.*?\}\}", "Ada and others", mit).replace("[[", "").replace("]]", "")
    short = mit[mit.index("permission is"): mit.index("[[the software is")].replace(
        "[[including the next paragraph]]", "")
    assert labels(f"Preface. {full.upper()}. More.") == ["mit"]
    assert labels(short) == ["mit"]
    assert labels(short.replace("free of charge", "for a charge")) == []
    assert SCANNER(full.encode())[1][0].n_words == len(license_scan.words_of(full.encode()))


def test_faulty_markup_is_an_error():
    for markup in ["a [[ b", "a ]] b", "[[a]]", "{{0-3}} a"]:
        with pytest.raises(ValueError):
            license_scan.Automaton(license_scan.parse(markup), {})


def test_automata_accept_what_regular_expressions_accept():
    draw = random.Random(5)
    words = "abc"

    def markup(depth):
        out = [draw.choice(words)]
        for _ in range(draw.randrange(1, 5)):
            kind = draw.randrange(5 if depth else 3)
            if kind < 3:
                out.append([draw.choice(words), "{{a b|c}}", "{{0-2}}"][kind])
            else:
                out.append(f"[[{markup(depth - 1)}]]")
        return " ".join(out)

    for _ in range(400):
        tree = license_scan.parse(markup(2))
        automaton = license_scan.Automaton(tree, {})
        pattern = re.compile(template_regex(tree))
        text = [draw.choice("abcx") for _ in range(12)]
        line = "".join(f"{w} " for w in text)
        for at in range(len(text)):
            # a backtracking search stops at its first way, so every end is tried
            ends = [e for e in range(at, 13) if pattern.fullmatch(line[2 * at: 2 * e])]
            assert automaton.run([w.encode() for w in text], at) == max(ends, default=-1)


def test_phrases_by_hand():
    draw = random.Random(6)
    parts = ["under", "the", "mit", "license", "Apache", "version", "2", "cc", "BY", "nc", "é", ",", "\n", "-"]
    for _ in range(2000):
        text = " ".join(draw.choice(parts) for _ in range(draw.randrange(0, 40)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
            c.lower() if "A" <= c <= "Z" else c for c in text))
        want = sorted(
            (i, label) for label, p in license_templates.PHRASES for i in range(len(words))
            if words[i: i + len(p.split())] == p.split()
        )
        n, found = SCANNER(text.encode())
        assert n == len(words)
        assert [(m.first_word, m.label) for m in found if m.phrase] == want


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "found", "matches", "base", "labels", "n_words")
    got = rows_of(license_scan.licenses(docs))
    assert len(got) == docs.count()
    assert all(r[2] == 0 and r[3] is None and r[5] == r[6] == "" and r[7] == 0.0 for r in got)
    assert license_scan.licenses(empty_docs(spark)).count() == 0


def test_long_texts_take_linear_time(spark):
    text = "licensed under the " * 300_000 + "mit license"
    n, found = SCANNER(text.encode())
    assert n == 900_002 and [m.label for m in found if not m.phrase] == ["mit"]
