"""Counts over whole texts for the quality operators, in one pass of Arrow batches.

Words are looked up once in a per-task table that keeps a number and a few marks for each
distinct word; the rest is arithmetic on arrays of those numbers.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ended_lines",
    "n_repeat_words", "n_same_next", "n_upper", "n_plain", "n_unique", "n_exclaim",
    "n_open_lines",
)
SYMBOLS = b"#*$%&|<>"
_BLANKS = b"\t\n\x0b\x0c\r "
_UPPER, _PLAIN, _MARKS = 1, 2, 2  # marks take the lowest two bits of a word's number
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:?]?")
_KNOWN = 1 << 20
# Unicode's sentence terminals, in groups of scripts; those that end like ! stand with them
_ENDS = (
    ".?!\u0589\u061d-\u061f\u06d4\u0700-\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965\u0f0d-\u0f12"
    "\u104a\u104b\u1362\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945\u1b5a\u1b5b"
    "\u1b5e\u1b5f\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047-\u2049\u2cf9-\u2cfb\u2e2e\u3002\ua4ff\ua60e"
    "\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua9c8\ua9c9\uaa5d-\uaa5f\uabeb\ufe12\ufe15\ufe16\ufe52"
    "\ufe56\ufe57\uff01\uff0e\uff1f\uff61"
)
_ENDED = re.compile(rf"[{_ENDS}][\u300d\u300f]?\Z")
# scripts that have no sign for the end of a sentence: Thai and Lao
_OPEN = re.compile(r"[\u0e01-\u0e4e\u0e81-\u0ecd\u0edc-\u0edf]\Z")
# commas and colons of other scripts, and marks that join letters without being seen
_PAUSES = "\u055d\u060c\u061b\u1363-\u1366\u3001\uff0c\uff1a\uff1b\uff64\ufe50\ufe51"
_OWN_SIGNS = re.compile(rf"[{_ENDS.removeprefix('.?!')}{_PAUSES}]+\u300d?\u300f?\Z")
# Han, Kana, Thai, Lao, Khmer and Burmese put no blanks between words, so signs lie inside
_UNSPACED = re.compile(
    r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]"
)
_INSIDE = re.compile(rf"[{_ENDS.removeprefix('.?!')}{_PAUSES}\u3008-\u3011\u30fb]+")


def is_plain(text: str) -> bool:
    """Letters with their marks, perhaps joined by ' or -, perhaps before a sign."""
    if _PLAIN_WORD.fullmatch(text):
        return True
    if text.isascii():
        return False
    bare = "".join(
        c for c in text if c not in "\u200c\u200d" and unicodedata.category(c)[0] != "M"
    )
    bare = _OWN_SIGNS.sub("", bare)
    if _UNSPACED.search(bare):
        bare = _INSIDE.sub("-", bare).strip("-")
    return bool(_PLAIN_WORD.fullmatch(bare))


def line_end(line: bytes) -> tuple[bool, bool]:
    """Whether a line ends a sentence, and whether its script has no sign for that."""
    last = line.rstrip(_BLANKS)
    if last[-1] < 0x80:
        return last[-1:] in (b".", b"?", b"!"), False
    tail = last[-8:].decode("utf-8", "ignore")
    return bool(_ENDED.search(tail)), bool(_OPEN.search(tail))


class Words(dict):
    """Number of each word met, with its marks in the low bits."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        marks = 0
        letters = text.strip(".,;:!?")
        if len(letters) > 1 and letters.isupper():
            marks |= _UPPER
        if is_plain(text):
            marks |= _PLAIN
        number = self[word] = len(self) << _MARKS | marks
        return number


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    if ids.max() < _KNOWN:
        codes = ids[:-2] << 40 | ids[1:-1] << 20 | ids[2:]
    else:  # more distinct words than fit: number pairs first
        _, one = np.unique(ids, return_inverse=True)
        width = int(one.max()) + 1
        _, two = np.unique(one[:-1] * width + one[1:], return_inverse=True)
        codes = two[:-1] * width + one[2:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(codes, np.unique(twice))
    marked = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        marked[shift : shift + n] |= hit
    return int(marked.sum())


def measure(text: str, known: Words) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at space and U+0009 to U+000D
    n = len(words)
    if len(known) > _KNOWN // 2:
        known.clear()
    numbers = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=n)
    ids = numbers >> _MARKS
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    ends = [line_end(x) for x in lines]
    return (
        n,
        len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        sum(ended for ended, _ in ends),
        _repeated(ids),
        int((ids[1:] == ids[:-1]).sum()),
        int((numbers & _UPPER).sum()),
        int((numbers & _PLAIN != 0).sum()),
        len(np.unique(ids)),
        raw.count(b"!"),
        sum(is_open for _, is_open in ends),
    )


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(column: pa.Array) -> pa.Array:
    known = Words()
    rows = [measure(x.as_py() or "", known) for x in column]
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays(
        [pa.array(columns[:, i]) for i in range(len(COUNTS))], names=list(COUNTS)
    )
