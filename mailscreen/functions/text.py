"""Text cleaning as native column expressions (columns in, columns out)."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.functions import charsets
from mailscreen.params import TextOptions


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for a body that mentions it several times.

    Composing string expressions by plain nesting would copy the inner expression at
    every mention; a one-element array makes Spark evaluate it once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"(?U)[^{lx.WS_CHARS}]")


def strip_ws(c: Column) -> Column:
    """Trim any Unicode white space, unlike SQL trim, which only knows the space."""
    return F.regexp_replace(c, rf"(?U)^{lx.WS}+|{lx.WS}+\z", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"(?U){lx.WS}+", " "))


def collapse_ws_lines(c: Column) -> Column:
    """Collapse blanks inside each line, keep at most one empty line in a row."""
    lines = F.transform(
        F.split(c, "\n", -1), lambda line: strip_ws(F.regexp_replace(line, "[ \t]+", " "))
    )
    return strip_ws(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, lx.CONTROL_CHARS, "")


def strip_style_script(c: Column) -> Column:
    return F.regexp_replace(c, lx.HTML_BLOCK, " ")


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, lx.HTML_COMMENT, " ")


def strip_tags(c: Column) -> Column:
    """Replace tags of any length by a space.

    What follows the last closing bracket holds no tag and is left out of the search, in
    which every opening bracket therefore finds its end.
    """
    rest = F.substring_index(c, ">", -1)
    head = F.substr(c, F.lit(1), F.length(c) - F.length(rest))
    return F.concat(F.regexp_replace(head, lx.HTML_TAG, " "), rest)


# ---------------------------------------------------------------- entities


def _from_code_point(n: Column) -> Column:
    c1 = F.split(F.lit(" ".join(charsets.c1_replacements())), " ")
    low = F.pmod(n, F.lit(0x10000))
    dropped = (
        n.between(0x1, 0x8)
        | n.between(0xB, 0x1F)
        | (n == 0x7F)
        | n.between(0xFDD0, 0xFDEF)
        | (low >= 0xFFFE)
    ) & (n != 0xC)
    replaced = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    hexed = F.hex(n.cast("bigint"))
    # big-endian UTF-16 leaves U+FEFF alone, which UTF-32 takes for a byte order mark
    char = F.when(n <= 0xFFFF, F.decode(F.unhex(F.lpad(hexed, 4, "0")), "UTF-16BE")).otherwise(
        F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
    )
    return (
        F.when(replaced, F.lit("�"))
        .when(n == 0xD, F.lit("\r"))
        .when(n.between(0x80, 0x9F), F.get(c1, n - 0x80))
        .when(dropped, F.lit(""))
        .otherwise(char)
    )


def _numeric_reference(name: Column) -> Column:
    digits = F.regexp_replace(
        F.regexp_extract(name, "^#[xX]?([0-9a-fA-F]+)", 1), "^0+", ""
    )
    base_ten = ~name.rlike("^#[xX]")
    # seven significant digits already exceed the last code point in either base
    code = (
        F.when(F.length(digits) > 7, F.lit(0x110000))
        .when(digits == "", F.lit(0))
        .when(base_ten, digits.try_cast("int"))
        .otherwise(F.conv(digits, 16, 10).try_cast("int"))
    )
    return let(code, _from_code_point)


def _named_reference(name: Column) -> Column:
    table = F.from_json(
        F.lit(charsets.entity_table_json()), "map<string,map<string,string>>"
    )
    bare_table = F.from_json(F.lit(charsets.bare_entities_json()), "map<string,string>")

    def by_prefix(bare: Column) -> Column:
        return F.when(bare == "", F.concat(F.lit("&"), name)).otherwise(
            F.concat(
                F.try_element_at(bare_table, bare), F.substr(name, F.length(bare) + 1)
            )
        )

    return F.coalesce(
        F.try_element_at(F.try_element_at(table, F.substring(name, 1, 2)), name),
        let(F.regexp_extract(name, charsets.bare_entity_pattern(), 0), by_prefix),
    )


def _after_ampersand(part: Column) -> Column:
    """Resolve the reference, if any, at the start of the text that follows an '&'."""
    name = F.regexp_extract(
        part, r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)", 0
    )

    def resolve(n: Column) -> Column:
        text = (
            F.when(n == "", F.lit("&"))
            .when(n.startswith("#"), _numeric_reference(n))
            .otherwise(_named_reference(n))
        )
        return F.concat(text, F.substr(part, F.length(n) + 1))

    def exact(entity: str, text: str) -> tuple[Column, Column]:
        return part.startswith(entity), F.concat(
            F.lit(text), F.substr(part, F.lit(len(entity) + 1))
        )

    # the everyday references skip the pattern and the table
    result = F.when(*exact("amp;", "&"))
    for entity, text in (
        ("nbsp;", "\xa0"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("#39;", "'"),
    ):
        result = result.when(*exact(entity, text))
    return result.otherwise(let(name, resolve))


def unescape(c: Column) -> Column:
    """Decode character references once, by the HTML5 rules.

    Every '&' starts at most one reference and no reference spans another '&', so the
    text can be cut at the ampersands and each piece resolved on its own.
    """
    def decode(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), _after_ampersand)
        return F.array_join(F.concat(F.slice(parts, 1, 1), tail), "")

    return F.when(F.contains(c, F.lit("&")), let(F.split(c, "&", -1), decode)).otherwise(c)


def strip_unescaped_html(unescaped: Column) -> Column:
    """The part of :func:`strip_html` after the first decoding pass."""
    no_markup = F.when(
        F.contains(unescaped, F.lit("<")),
        strip_tags(strip_comments(strip_style_script(unescaped))),
    ).otherwise(unescaped)
    return collapse_ws(let(no_markup, unescape))


def strip_html(c: Column) -> Column:
    return let(let(c, unescape), strip_unescaped_html)


# ---------------------------------------------------------------- folding


def ascii_fold(c: Column) -> Column:
    """Decompose compatibility characters and drop whatever is not ASCII."""
    single_from, single_to, multi = charsets.ascii_fold_tables()
    multi_map = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")

    def spell_out(x: Column) -> Column:
        chars = F.transform(
            F.split(x, ""), lambda ch: F.coalesce(F.try_element_at(multi_map, ch), ch)
        )
        # deleting the one-to-many characters from the non-ASCII rest shows if any occur
        rest = F.regexp_replace(x, r"[\x00-\x7f]+", "")
        without = F.translate(rest, "".join(multi), "")
        return F.when(F.length(without) < F.length(rest), F.array_join(chars, "")).otherwise(x)

    def fold(x: Column) -> Column:
        folded = F.translate(let(x, spell_out), single_from, single_to)
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(
            F.regexp_replace(folded, r"[^\x00-\x7f]", "")
        )

    return let(c, fold)


def tidy(c: Column, fold: bool = True) -> Column:
    """Control characters out, optionally fold, collapse white space."""
    c = strip_control(c)
    if not fold:
        return collapse_ws(c)
    # folded text has no white space left beyond these four
    return F.trim(F.regexp_replace(ascii_fold(c), r"[\t\n\r ]{2,}|[\t\n\r]", " "))


def clean_body(c: Column, fold_unicode: bool = True) -> Column:
    return tidy(strip_html(F.coalesce(c, F.lit(""))), fold_unicode)


def clean_subject(c: Column) -> Column:
    return tidy(F.coalesce(c, F.lit("")))


def prepare_text(
    subject_clean: Column, body_clean: Column, options: TextOptions = TextOptions()
) -> Column:
    """Model input text: cleaned subject, separator and body, cut only if a length is set."""
    text = body_clean
    if options.include_subject:
        joined = F.concat(subject_clean, F.lit(options.separator), body_clean)
        text = F.when(subject_clean != "", joined).otherwise(body_clean)
    if options.max_text_length is None:
        return text
    return F.substring(text, 1, options.max_text_length)


# ---------------------------------------------------------------- counts


def lexicon_terms(terms: tuple[str, ...], fold: bool) -> tuple[str, ...]:
    """The terms as they are searched for, folded like the text if so wanted."""
    if not fold:
        return terms
    single_from, single_to, _ = charsets.ascii_fold_tables()
    table = str.maketrans(single_from, single_to)
    return tuple(dict.fromkeys(t.translate(table) for t in terms))


def _term_groups(terms: tuple[str, ...], fold: bool) -> Column:
    """Terms grouped by their first four letters, each group with its common prefix.

    A text without the prefix holds no term of the group, so one scan rules out, say,
    all inflections of a word.
    """
    groups: dict[str, list[str]] = {}
    for term in lexicon_terms(terms, fold):
        groups.setdefault(term[:4], []).append(term)
    literal = json.dumps(
        [{"prefix": os.path.commonprefix(g), "terms": g} for g in groups.values()]
    )
    return F.from_json(F.lit(literal), "array<struct<prefix:string,terms:array<string>>>")


def _present_groups(low: Column, groups: Column) -> Column:
    return F.filter(groups, lambda g: F.contains(low, g["prefix"]))


def _count_terms(c: Column, groups: Column) -> Column:
    def count(low: Column) -> Column:
        hits = F.transform(
            _present_groups(low, groups),
            lambda g: F.size(F.filter(g["terms"], lambda term: F.contains(low, term))),
        )
        return F.aggregate(hits, F.lit(0), lambda acc, n: acc + n)

    return let(F.lower(c), count)


def _has_term(c: Column, groups: Column) -> Column:
    return let(
        F.lower(c),
        lambda low: F.exists(
            _present_groups(low, groups),
            lambda g: F.exists(g["terms"], lambda term: F.contains(low, term)),
        ),
    )


def count_urgency(c: Column, fold_lexicon: bool = False) -> Column:
    """Number of distinct persuasion terms occurring as substrings."""
    return _count_terms(c, _term_groups(lx.URGENCY_TERMS, fold_lexicon))


def has_urgency(c: Column, fold_lexicon: bool = False) -> Column:
    return _has_term(c, _term_groups(lx.URGENCY_TERMS, fold_lexicon))


def count_brands(c: Column) -> Column:
    return _count_terms(c, _term_groups(lx.BRAND_TERMS, False))


def has_brand(c: Column) -> Column:
    return _has_term(c, _term_groups(lx.BRAND_TERMS, False))


def word_count(collapsed: Column) -> Column:
    """White-space separated words of text whose white space is already collapsed."""
    return F.when(collapsed == "", 0).otherwise(
        F.length(collapsed) - F.length(F.replace(collapsed, F.lit(" "), F.lit(""))) + 1
    ).cast("int")


def count_digits(c: Column, ascii_only: bool = True) -> Column:
    pattern = "[0-9]" if ascii_only else charsets.class_where(str.isdigit)
    return F.regexp_count(c, F.lit(pattern))


def count_special(c: Column, ascii_only: bool = True) -> Column:
    """Characters that are neither letters, digits nor white space."""
    if ascii_only:
        return F.length(c) - F.length(F.translate(c, lx.ASCII_SPECIAL, ""))
    alnum = charsets.class_where(str.isalnum)[1:-1]
    return F.regexp_count(c, F.lit(f"(?U)[^{alnum}{lx.WS_CHARS}]"))


def count_letters(c: Column, ascii_only: bool = True) -> Column:
    letters = "[A-Za-z]" if ascii_only else charsets.class_where(str.isalpha)
    return F.length(c) - F.length(F.regexp_replace(c, letters + "+", ""))


def ratio_uppercase(
    c: Column, ascii_only: bool = True, n_letters: Column | None = None
) -> Column:
    """Upper-case share of the letters, 0 without letters."""
    upper = (
        "[A-Z]"
        if ascii_only
        else f"[{charsets.class_where(str.isupper)}&&{charsets.class_where(str.isalpha)}]"
    )
    n_letters = count_letters(c, ascii_only) if n_letters is None else n_letters
    return share_of_letters(F.regexp_count(c, F.lit(upper)), n_letters)


def share_of_letters(n: Column, n_letters: Column) -> Column:
    return F.coalesce(F.round(n / F.nullif(n_letters, F.lit(0)), 4), F.lit(0.0))


def count_exclaim(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("!"), F.lit("")))


def has_html(raw_body: Column) -> Column:
    before_last = F.length(raw_body) - F.length(F.substring_index(raw_body, ">", -1))
    return F.substr(raw_body, F.lit(1), before_last).rlike(lx.HTML_MARK)


def has_form(raw_body: Column) -> Column:
    return raw_body.rlike(lx.FORM_MARK)


def has_iframe(raw_body: Column) -> Column:
    return raw_body.rlike(lx.IFRAME_MARK)


def is_reply_forward(subject_clean: Column) -> Column:
    return subject_clean.rlike(lx.REPLY_MARK)


def tokens(c: Column) -> Column:
    """Lower-cased word tokens of two or more characters, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(lx.TOKEN), F.lit(0))
