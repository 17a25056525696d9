"""Secrets in texts by assignment-aware lexing.

Texts are lexed into statements, over line ends: a name (bare or quoted, dotted or dashed),
perhaps a type, a sign, and terms joined by `+` or standing side by side in brackets that
are string literals, bare words or names. Indented blocks of YAML and the text of XML
elements are terms too; `+=` joins its terms to what the name was bound to.
Every statement binds its name to its literals, and a term that is a bound name stands for
what it was bound to, so a constant is followed to the name that uses it, through any number
of steps. An authorization scheme (`Bearer`) opens a value and is not part of it.
Literals are then scored: how sensitive the target name is, by its parts, plus how much
the literal looks like key material. Literals of statements that score enough are added
as kind `literal`, at the place where the literal stands, unless a base span covers it.

Base spans come from three fixed patterns and always stay. Positions are code points, end
exclusive.

Defined results: null and empty texts have no spans; very long texts are read whole, in
time linear in their length; rows are judged each by itself, so ids may be null or repeat
and repeated rows come back as often as they occur; an empty table gives no rows; further
columns of the input, however named, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "literal")

# fixed values: the base patterns
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# name, perhaps quoted, perhaps a type, and the sign of an assignment; names start where no
# name goes on. A type's brackets end before the next single colon, so that no stretch is
# read again from each of many names.
_TYPE = r"""[&*]*+(?:'\w++[ \t]++)?(?:\[\w*+\])?[A-Za-z_][\w.]*+(?:::\w++)*+
    (?:[\[<(](?:[^\n=:"'`;{}]|::)*+|[?!*|&\[\] \t]*+(?:[A-Za-z_][\w.]*+)?)[ \t]*+"""
TARGET = re.compile(
    rf"""(?<![\w$.-])(?:
    (?:var|const|static|dim|declare|DECLARE|Dim)[ \t]++@?([A-Za-z_$][\w$]*+)[ \t]++(?:[Aa]s[ \t]++)?{_TYPE}:?=(?![=>])
    |([A-Za-z_$][\w$]*+(?:[.-][\w$]++)*+)["'`]?(?:\[\w*+\]|\])?[?!]?[ \t]*+
    (?::[ \t]*+{_TYPE}(=)(?![=>])|(\+=|\.=)|:=|=>|(?:\?\?|\|\||\?)=|=(?!=)|:(?!//|:)))[ \t]*+""",
    re.VERBOSE,
)
TERM = re.compile(
    r"""\x22{3}(.*?)\x22{3}|'{3}(.*?)'{3}|[rbfuRBFU]{0,2}"((?:[^"\\\n]|\\.)*+)"|[rbfuRBFU]{0,2}'((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`|([A-Za-z0-9+/_.=$~-]++)""",
    re.DOTALL,
)
_BARE = 6  # the group of TERM that is not quoted
PLUS = re.compile(r"[ \t]*+(?:\\?\r?\n\s*+)?\+(?!=)[ \t]*+(?:\\?\r?\n\s*+)?")
OPENING = re.compile(r"[(\[][(\[\s]*+")
BLANK = re.compile(r"[ \t]*+\\?\r?\n\s*+")
BETWEEN = re.compile(r"\s*+(?:,\s*+)?")
# an authorization scheme opens a value and is none
SCHEME = re.compile(r"(?:bearer|basic|negotiate|digest)[ \t]++(?=[\w+/.~-])", re.IGNORECASE)
BLOCK = re.compile(r"[|>][-+0-9]*+[ \t]*+\r?\n")
ELEMENT = re.compile(
    r"<([A-Za-z_][\w:.-]*+)(?:\s[^<>]*+)?>(?:\s*+<!\[CDATA\[([^<>]*+)>\s*+|([^<>]*+))</\1\s*+>"
)
NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][\w$]+)*")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# how far a part of a name says that its value is a secret
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "passcode": 0.9,
    "secret": 1.0, "secrets": 1.0, "credential": 0.9, "credentials": 0.9, "token": 0.9,
    "apikey": 1.0, "auth": 0.5, "authorization": 0.7, "bearer": 0.8, "private": 0.5,
    "access": 0.4, "api": 0.4, "key": 0.4, "signing": 0.4, "encryption": 0.5, "salt": 0.5,
    "cookie": 0.4, "session": 0.4, "dsn": 0.5, "pat": 0.4,
}
# values that stand for a secret without being one
STAND_INS = {
    "password", "passwd", "secret", "token", "changeme", "example", "placeholder", "none",
    "null", "true", "false", "undefined", "required", "optional", "string", "redacted",
}


@dataclass(frozen=True)
class ScanParams:
    least_score: float = 1.2
    least_length: int = 6


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name.replace("_", " "))]
    return min(1.0, sum(SENSITIVE.get(p, 0.0) for p in parts))


class Value:
    """What a name is bound to: a literal, or the values it joins.

    Values share their parts, so a constant built in many steps costs one step each. Of the
    text only what is scored is kept: its length, its beginning and how often each
    character occurs; both follow from the parts.
    """

    __slots__ = ("parts", "place", "length", "head", "counts", "reported", "n_names")

    def __init__(self, parts=(), text: str = "", place: tuple[int, int] | None = None, old=None):
        """`old` is the value that this one takes the place of, if it is known as nothing else."""
        self.parts, self.place, self.reported, self.n_names = parts, place, False, 0
        self.length = len(text) + sum(p.length for p in parts)
        self.head = text[:_HEAD]
        if old is not None and parts[0] is old and parts.count(old) == 1:
            # nobody asks the old value again, so its counts go on in this one
            self.counts, old.counts = old.counts, None
            counted = parts[1:]
        else:
            self.counts, counted = Counter(text), parts
        for p in counted:
            self.counts.update(p.counts)
        for p in parts:
            if len(self.head) >= _HEAD:
                break
            self.head += p.head[: _HEAD - len(self.head)]

    def places(self):
        """Places of the literals that were not reported before."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.reported:
                value.reported = True
                todo += value.parts
                if value.place:
                    yield value.place


# longer than any value that stands for a secret
_HEAD = 24


def value_score(value: Value, params: ScanParams) -> float:
    """0 for what cannot be a secret, up to 1 for long mixed random text."""
    n, counts = value.length, value.counts
    if n < params.least_length or (n < _HEAD and value.head.lower() in STAND_INS):
        return 0.0
    if value.head.startswith(("${", "{{", "<", "%(", "$")) or len(counts) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    classes = sum(
        any(f(c) for c in counts)
        for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())
    )
    blanks = sum(c for x, c in counts.items() if x.isspace())
    # far more blanks than any secret has; a float need not hold the number
    return max(0.0, min(1.0, entropy / 5 + 0.15 * (classes - 1) - 0.2 * min(blanks, 100)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found = [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _block(text: str, name_at: int, at: int):
    """Terms of the lines from `at` on that are indented more than the line of the name."""
    line = text.rfind("\n", 0, name_at) + 1
    indent = len(text[line:name_at]) - len(text[line:name_at].lstrip(" \t-"))
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        x = text[at:end]
        if x.strip():
            if len(x) - len(x.lstrip(" \t")) <= indent:
                return
            a = at + len(x) - len(x.lstrip())
            yield x.strip(), a, a + len(x.strip()), True
        at = end + 1


def _terms(text: str, at: int):
    """Terms from `at` on: joined by plus, or side by side in brackets."""
    inside = False
    if opening := OPENING.match(text, at):
        at, inside = opening.end(), True
    elif blank := BLANK.match(text, at):  # on the next line only what is quoted is a value
        t = TERM.match(text, blank.end())
        if not t or t.lastindex == _BARE:
            return
        at = blank.end()
    if scheme := SCHEME.match(text, at):
        at = scheme.end()
    while t := TERM.match(text, at):
        group = t.lastindex
        start = t.start(group)
        if scheme := SCHEME.match(t[group]):
            start += scheme.end()
        yield text[start : t.end(group)], start, t.end(group), group < _BARE
        if plus := PLUS.match(text, t.end()):
            at = plus.end()
        elif inside and group < _BARE:
            at = BETWEEN.match(text, t.end()).end()
            if at < len(text) and text[at] not in "\"'`rbfuRBFU":
                return
        else:
            return


def statements(text: str):
    """(name, joins what is bound, terms) of every assignment, in order of their places.

    A term is (value, start, end, quoted).
    """
    found = []
    for m in TARGET.finditer(text):
        block = BLOCK.match(text, m.end())
        terms = list(_block(text, m.start(), block.end()) if block else _terms(text, m.end()))
        if terms:
            found.append((m.start(), m[1] or m[2], bool(m[4]), terms))
    if "</" in text:
        for m in ELEMENT.finditer(text):
            inner = m[m.lastindex]
            value = inner.removesuffix("]]").strip()
            if value:
                a = m.start(m.lastindex) + len(inner) - len(inner.lstrip())
                found.append((m.start(), m[1], False, [(value, a, a + len(value), True)]))
        found.sort(key=lambda x: x[0])
    return [x[1:] for x in found]


def literal_spans(text: str, params: ScanParams) -> list[tuple[int, int, str]]:
    if not (":" in text or "=" in text or "</" in text):
        return []
    bound: dict[str, Value] = {}
    found = set()
    for name, joins, terms in statements(text):
        parts = [bound[name]] if joins and name in bound else []
        for term, a, b, quoted in terms:
            if not quoted and NAME.fullmatch(term) and term in bound:
                parts.append(bound[term])
            else:
                parts.append(Value(text=term, place=(a, b)))
        old = bound.get(name)
        if old is not None:
            old.n_names -= 1
            if old.n_names:
                old = None
        value = bound[name] = parts[0] if len(parts) == 1 else Value(parts, old=old)
        value.n_names += 1
        sensitive = name_score(name)
        if sensitive and sensitive + value_score(value, params) >= params.least_score:
            found.update(value.places())
    return [(a, b, "literal") for a, b in found if b > a]


def scan(text: str, params: ScanParams = ScanParams()) -> tuple[list, list]:
    """(base spans, all spans), each a list of (start, end, kind) in order."""
    def order(s: tuple[int, int, str]) -> tuple[int, int, int]:
        return s[0], KINDS.index(s[2]), s[1]

    base = sorted(base_spans(text), key=order)
    added = []
    if literals := literal_spans(text, params):
        added = [
            s for s in literals if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)
        ]
    return base, sorted(base + added, key=order)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FOUND = T.StructType([
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])


def secrets(docs: DataFrame, params: ScanParams = ScanParams()) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    @F.arrow_udf(_FOUND)
    def found(column: pa.Array) -> pa.Array:
        rows = []
        for x in column:
            base, every = scan(x.as_py() or "", params)
            kinds = Counter(kind for _, _, kind in base)
            digest = hashlib.sha256(listed(base).encode()).hexdigest()
            rows.append((kinds["assign"], kinds["access"], kinds["hex"], digest, listed(every)))
        kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows) if rows else [[]] * 5
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds_of)], names=_FOUND.names
        )

    return docs.select("doc_id", found("text").alias("found")).select("doc_id", "found.*")
