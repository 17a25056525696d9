"""Token counts by byte-pair merging with a heap and a linked list.

A text is split at the tokenizer's added tokens, one token each, and the rest by its
pattern into pieces. Each piece starts as one symbol a byte; the adjacent pair of lowest
rank, leftmost first, is merged until no pair has a rank. The heap holds candidate pairs,
the linked list the neighbours of every symbol. The count is the number of initial
symbols less the merges; token identifiers are never formed. Counts of short pieces are
remembered within a task, in a table of bounded size.

The vocabulary file is read on the driver and sent to the tasks; it does not grow with
the data.

Defined results: null and empty texts have no bytes and no tokens; texts of any length are
counted whole; rows are judged each by itself, so ids may be null or repeat and repeated
rows come back as often as they occur; an empty table gives no rows; further columns of the
input, however named, are ignored.
"""

from __future__ import annotations

import heapq
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.llm.staging import text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: the pattern that byte-level vocabularies of this kind split text by
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
REMEMBERED, REMEMBERED_LENGTH = 1 << 19, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Counter:
    """Counts tokens of texts for one byte-level BPE vocabulary in JSON form."""

    def __init__(self, content: str):
        spec = json.loads(content)
        split = spec["pre_tokenizer"] or {}
        if (
            spec["model"]["type"] != "BPE" or spec.get("normalizer")
            or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        bytes_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = tuple(b"".join(map(bytes_of.get, side)) for side in (left, right))
            self.ranks.setdefault(key, rank)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """Initial symbols less merges."""
        n = len(piece)
        symbol = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, count = self.ranks, n
        heap = [
            (rank, i) for i in range(n - 1)
            if (rank := ranks.get((symbol[i], symbol[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # stale unless both neighbours still stand and still form this very pair
            if symbol[i] is None or j >= n or ranks.get((symbol[i], symbol[j])) != rank:
                continue
            symbol[i] += symbol[j]
            symbol[j] = None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (rank, i))
            h = before[i]
            if h >= 0 and (rank := ranks.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (rank, h))
        return count

    def piece(self, piece: str) -> int:
        count = self.known.get(piece)
        if count is None:
            count = self.merged(piece.encode("utf-8"))
            if len(piece) <= REMEMBERED_LENGTH:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = count
        return count

    def plain(self, text: str) -> int:
        count, known = 0, self.known
        for m in self.pieces.finditer(text):
            piece = m[0]
            n = known.get(piece)
            count += self.piece(piece) if n is None else n
        return count

    def __call__(self, text: str) -> int:
        if self.added is None:
            return self.plain(text)
        count, start = 0, 0
        for m in self.added.finditer(text):
            count += self.plain(text[start : m.start()]) + 1
            start = m.end()
        return count + self.plain(text[start:] if start else text)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more tokens than `limit`)."""
    with open(vocabulary, encoding="utf-8") as file:
        content = file.read()
    Counter(content)  # an unsupported file fails here, not in a task
    shared = docs.sparkSession.sparkContext.broadcast(content)

    @F.arrow_udf(T.LongType())
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(shared.value)
        for column in batches:
            yield pa.array([counter(x.as_py() or "") for x in column], pa.int64())

    return docs.select(
        "doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        n_tokens("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
