"""Character tables generated by rule from the Unicode and HTML data Python ships."""

from __future__ import annotations

import html.entities
import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache


@lru_cache(maxsize=1)
def ascii_fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition reduced to ASCII.

    Returns two aligned strings (code points that become one ASCII character) and a map
    for those that become several. Code points missing from both leave no ASCII.
    """
    single_from, single_to, multi = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if not unicodedata.decomposition(ch):
            continue
        kept = "".join(c for c in unicodedata.normalize("NFKD", ch) if c < "\x80")
        if len(kept) == 1:
            single_from.append(ch)
            single_to.append(kept)
        elif kept:
            multi[ch] = kept
    return "".join(single_from), "".join(single_to), multi


def regex_class(chars: str) -> str:
    """A Java regex class matching exactly the given characters."""
    codes = sorted(map(ord, set(chars)))
    parts, start, prev = [], None, None
    for code in [*codes, None]:
        if start is None:
            start = prev = code
        elif code is not None and code == prev + 1:
            prev = code
        else:
            parts.append(
                f"\\x{{{start:x}}}" if start == prev else f"\\x{{{start:x}}}-\\x{{{prev:x}}}"
            )
            start = prev = code
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=None)
def class_where(predicate: Callable[[str], bool]) -> str:
    """Regex class of every code point a Python string predicate accepts."""
    return regex_class("".join(
        chr(c) for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF and predicate(chr(c))
    ))


def nested_class(codes: list[int]) -> str:
    """The class of :func:`regex_class`, as a tree that a character passes in few steps.

    Java tries the ranges of a flat class one after another, some 700 for all letters. Here
    every class in brackets stands behind the range it lies in, and ASCII comes first.
    """
    def tree(part: list[int]) -> str:
        if len(part) <= 16:
            return regex_class("".join(map(chr, part)))
        half = len(part) // 2
        sides = [
            f"[\\x{{{side[0]:x}}}-\\x{{{side[-1]:x}}}&&{tree(side)}]"
            if side[-1] - side[0] >= len(side) else f"[\\x{{{side[0]:x}}}-\\x{{{side[-1]:x}}}]"
            for side in (part[:half], part[half:])
        ]
        return "[" + "".join(sides) + "]"

    ascii_part = [c for c in codes if c < 0x80]
    rest = [c for c in codes if c >= 0x80]
    parts = [regex_class("".join(map(chr, ascii_part)))] if ascii_part else []
    if rest:
        parts.append(f"[\\x{{80}}-\\x{{10ffff}}&&{tree(rest)}]")
    return "[" + "".join(parts) + "]"


@lru_cache(maxsize=None)
def nested_class_where(predicate: Callable[[str], bool]) -> str:
    """As :func:`class_where`, nested."""
    return nested_class([
        c for c in range(sys.maxunicode + 1)
        if not 0xD800 <= c <= 0xDFFF and predicate(chr(c))
    ])


@lru_cache(maxsize=1)
def entity_table_json() -> str:
    """Named references, grouped by their first two letters to keep map lookups short."""
    table: dict[str, dict[str, str]] = {}
    for name, text in html.entities.html5.items():
        table.setdefault(name[:2], {})[name] = text
    return json.dumps(table)


@lru_cache(maxsize=1)
def bare_entities_json() -> str:
    """The legacy names valid without a semicolon."""
    return json.dumps({n: t for n, t in html.entities.html5.items() if not n.endswith(";")})


@lru_cache(maxsize=1)
def bare_entity_pattern() -> str:
    """The legacy names valid without a semicolon, longest first."""
    bare = [n for n in html.entities.html5 if not n.endswith(";")]
    bare.sort(key=lambda n: (-len(n), n))
    return "^(?:" + "|".join(bare) + ")"


@lru_cache(maxsize=1)
def c1_replacements() -> list[str]:
    """Numeric references 0x80-0x9F are read as Windows-1252 where that defines them."""
    out = []
    for code in range(0x80, 0xA0):
        try:
            out.append(bytes([code]).decode("cp1252"))
        except UnicodeDecodeError:
            out.append(chr(code))
    return out
