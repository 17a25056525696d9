"""Licenses in texts by matching of template markup.

A template (see `license_templates`) is read into a tree of mandatory words, optional
regions and replaceable regions, and compiled into an automaton over words. Its
deterministic states are sets of the compiled states, made as texts ask for them. From every
word that can open a template the automaton runs until no state is left, and the longest
accepted run of words is a match: all mandatory wording is there, word for word, and what
stands in between is what the markup allows. Matches of one template do not overlap, the
leftmost stays; phrases, which have mandatory words alone, match at every place.

A template whose rarest kind of word (its longest mandatory one) is not in the text at
all is not tried. A run is as long as its template at most, so time is linear in the text.

Words are runs of digits, a to z and characters beyond ASCII, after A to Z are lower-cased.

Defined results: null and empty texts have no words and no matches; very long texts are
read whole; rows are judged each by itself, so ids may be null or repeat and repeated rows
come back as often as they occur; an empty table gives no rows; templates that end at the
same place are all reported; further columns of the input are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.llm import license_templates

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(license_templates)

# bytes that separate words become blanks, A to Z become a to z
_WORD_BYTES = bytes(
    b | 0x20 if 0x41 <= b <= 0x5A
    else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else 0x20
    for b in range(256)
)
_MARK = re.compile(r"\[\[|\]\]|\{\{(.*?)\}\}", re.DOTALL)
_RANGE = re.compile(r"\s*(\d+)-(\d+)\s*")
# sets of states remembered for one template before they are forgotten
_REMEMBERED = 1 << 14


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


# --- the tree of a template: lists of nodes ---------------------------------------------


@dataclass(frozen=True)
class Word:
    word: bytes


@dataclass(frozen=True)
class Optional:
    inner: tuple


@dataclass(frozen=True)
class OneOf:
    wordings: tuple


@dataclass(frozen=True)
class AnyWords:
    least: int
    most: int


def parse(markup: str) -> tuple:
    """The nodes of a template."""
    open_regions: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        stop = mark.start() if mark else len(markup)
        open_regions[-1] += map(Word, words_of(markup[at:stop].encode()))
        if mark is None:
            break
        at = mark.end()
        if mark[0] == "[[":
            open_regions.append([])
        elif mark[0] == "]]":
            if len(open_regions) == 1:
                raise ValueError(f"a region ends that was not begun: {markup!r}")
            inner = tuple(open_regions.pop())
            open_regions[-1].append(Optional(inner))
        elif several := _RANGE.fullmatch(mark[1]):
            open_regions[-1].append(AnyWords(int(several[1]), int(several[2])))
        else:
            wordings = [tuple(map(Word, words_of(x.encode()))) for x in mark[1].split("|")]
            open_regions[-1].append(OneOf(tuple(wordings)))
    if len(open_regions) > 1:
        raise ValueError(f"a region is not ended: {markup!r}")
    return tuple(open_regions[0])


def mandatory(nodes: tuple) -> int:
    """The fewest words of given wording in any text that the template accepts."""
    fewest = 0
    for node in nodes:
        if isinstance(node, Word):
            fewest += 1
        elif isinstance(node, OneOf):
            fewest += min(map(len, node.wordings))
    return fewest


class Automaton:
    """Accepts the runs of words that a template's markup allows."""

    def __init__(self, nodes: tuple, spellings: dict[bytes, bytes]):
        self.spellings = spellings
        self.steps: list[dict[bytes, int]] = []  # by a given word
        self.others: list[int | None] = []  # by any word
        self.free: list[list[int]] = []  # by no word
        start = self._state()
        self.end = self._add(nodes, start)
        self.words = {w for step in self.steps for w in step}
        self.start = self._closure({start})
        self.moves: dict[frozenset, dict[bytes | None, frozenset]] = {}
        self.first = {w for s in self.start for w in self.steps[s]}
        if self.end in self.start or any(self.others[s] is not None for s in self.start):
            raise ValueError("a template has to begin with given words")
        rarest = max((n.word for n in nodes if isinstance(n, Word)), key=len)
        self.rarest = [rarest, *(w for w, same in spellings.items() if same == rarest)]

    def _state(self) -> int:
        self.steps.append({})
        self.others.append(None)
        self.free.append([])
        return len(self.steps) - 1

    def _add(self, nodes: tuple, at: int) -> int:
        """States for the nodes from a state on; the state behind them."""
        for node in nodes:
            if isinstance(node, Word):
                after = self._state()
                word = self._state()
                self.free[at].append(word)
                self.steps[word][self.spellings.get(node.word, node.word)] = after
                at = after
                continue
            end = self._state()
            if isinstance(node, Optional):
                self.free[at].append(end)
                self.free[self._add(node.inner, at)].append(end)
            elif isinstance(node, OneOf):
                for wording in node.wordings:
                    self.free[self._add(wording, at)].append(end)
            else:
                for n in range(node.most):
                    if n >= node.least:
                        self.free[at].append(end)
                    into, after = self._state(), self._state()
                    self.free[at].append(into)
                    self.others[into] = after
                    at = after
                self.free[at].append(end)
            at = end
        return at

    def _closure(self, states: set[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def _move(self, states: frozenset, word: bytes | None) -> frozenset:
        into = {self.steps[s][word] for s in states if word in self.steps[s]}
        into |= {self.others[s] for s in states if self.others[s] is not None}
        return self._closure(into)

    def run(self, words: list[bytes], at: int) -> int:
        """The end of the longest run accepted from a word on, or -1."""
        if len(self.moves) > _REMEMBERED:
            self.moves.clear()
        states, longest, known, same = self.start, -1, self.words, self.spellings
        while True:
            if self.end in states:
                longest = at
            if at == len(words):
                return longest
            word = words[at]
            word = same.get(word, word)
            if word not in known:
                word = None
            moves = self.moves.get(states)
            if moves is None:
                moves = self.moves[states] = {}
            following = moves.get(word)
            if following is None:
                following = moves[word] = self._move(states, word)
            if not following:
                return longest
            states, at = following, at + 1


@dataclass(frozen=True)
class Match:
    label: str
    phrase: bool
    first_word: int
    n_words: int
    mandatory: int


class Scanner:
    """All templates and phrases against texts."""

    def __init__(self, phrases, templates, spellings: dict[str, str]):
        same = {a.encode(): b.encode() for a, b in spellings.items()}
        self.compiled = [(label, True, Automaton(parse(p), {}), parse(p)) for label, p in phrases]
        self.compiled += [
            (label, False, Automaton(parse(t), same), parse(t))
            for label, wordings in templates for t in wordings
        ]
        self.compiled = [(a, b, c, mandatory(d)) for a, b, c, d in self.compiled]

    def __call__(self, data: bytes) -> tuple[int, list[Match]]:
        """The number of words and the matches by place and label."""
        words = data.translate(_WORD_BYTES)
        tried = [x for x in self.compiled if any(w in words for w in x[2].rarest)]
        words = words.split()
        if not tried:
            return len(words), []
        opened: dict[bytes, list[int]] = {}
        for i, (_, _, automaton, _) in enumerate(tried):
            for word in automaton.first:
                opened.setdefault(word, []).append(i)
            for word, canonical in automaton.spellings.items():
                if canonical in automaton.first:
                    opened.setdefault(word, []).append(i)
        free_from = [0] * len(tried)
        found = set()
        for at, word in enumerate(words):
            for i in opened.get(word, ()):
                label, phrase, automaton, fewest = tried[i]
                if at < free_from[i]:
                    continue
                end = automaton.run(words, at)
                if end >= 0:
                    found.add((at, label, phrase, end - at, fewest))
                    if not phrase:
                        free_from[i] = end
        return len(words), [
            Match(label, phrase, at, n, fewest) for at, label, phrase, n, fewest in sorted(found)
        ]


_MATCH = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType()),
    T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("mandatory", T.LongType()),
])
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("matches", T.ArrayType(_MATCH)),
])
_ARROW_MATCH = pa.struct([
    ("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()),
    ("n_words", pa.int64()), ("mandatory", pa.int64()),
])


def license_matches(
    docs: DataFrame, phrases=None, templates=None, spellings: dict[str, str] | None = None
) -> DataFrame:
    """Per document: doc_id, n_words and matches, in order of their places.

    A match is (label, phrase, first_word, n_words, mandatory): whether a phrase of the
    base rule matched or a template, the words it covers, and the fewest words of given
    wording that its template asks for.
    """
    if phrases is None:
        phrases = license_templates.PHRASES
    if templates is None:
        templates = license_templates.TEMPLATES
    if spellings is None:
        spellings = license_templates.SPELLINGS
    Scanner(phrases, templates, spellings)  # faulty markup fails here, not in a task

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(phrases, templates, spellings)
        for column in batches:
            rows = [scanner(x.as_py() or b"") for x in column]
            yield pa.StructArray.from_arrays(
                [
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([[vars(m) for m in ms] for _, ms in rows], pa.list_(_ARROW_MATCH)),
                ],
                names=_FOUND.names,
            )

    return docs.select(
        "doc_id", found(F.col("text").cast("binary")).alias("found")
    ).select("doc_id", "found.*")


def labels_of(matches: Column) -> Column:
    labels = F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"])))
    return F.array_join(labels, ",")


def licenses(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is m / (m + 4) for the most mandatory words m of any match, 0 without one.
    """
    base = F.filter("matches", lambda m: m["phrase"])
    places = F.transform("base", lambda m: m["first_word"])
    most = F.array_max(F.transform("matches", lambda m: m["mandatory"])).cast("double")
    return license_matches(docs).withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        labels_of(F.col("base")).alias("base_labels"), labels_of(F.col("matches")).alias("labels"),
        F.coalesce(most / (most + 4), F.lit(0.0)).alias("score"),
    )
