"""Repair of the turn structure of conversations by a grammar-compressed shortest-edit search.

Rows of a conversation, by turn (null first; ties by role, then by the digest of the text), are symbols: the class
of the role (initial s, u, a, other) and whether the row must be deleted (blank, or equal in
role and text to an earlier row), is truncated, or is sound. Edits keep, rerole or delete a
row, or insert a turn before it; afterwards the role initials have to be `(s?(ua)+)?`.

The search is a product of matrices over (min, +). States are what has been written:
nothing, s, u, a. Entry (p, q) of a symbol's matrix is the cheapest way from p to q over its
row; ways of equal cost are told apart by their audit, the initials of their edits, of which
the least in ASCII counts. Inserts stand before the edit of the row that follows, so two
audits over the same rows are equal or differ before either ends, and which is less can be
told from the parts: first by the left part, then by the right. Every entry thus keeps its
cost, its rank among the entries of its state and, as a rope, the two entries it joins.

Symbol sequences of all conversations are compressed together by Re-Pair: adjacent pairs
that occur most often become rules, round by round, counted by Spark over the distinct
sequences; pairs replaced in one round have no symbol that is a left side of one and a right
side of another, so they cannot overlap. One matrix per rule is made from those of its two
sides, bottom-up, and shared by all conversations. Equal sequences are solved once.

Conversations are read in order, in batches, never collected: a task holds one byte a row
of a conversation, and the hash of a repaired conversation is fed row by row. The result
holds one character a row, so this bounds nothing that the result does not.

Defined results: null roles and texts count as one space, also a null id or turn in the
damage's key; rows with null id are one conversation; null turns come first and count in no
gap; rows equal in all columns are repeated rows, the later ones duplicates; a conversation
without rows after the damage has zeros, an empty audit and the hash of the empty string; an
empty table gives no rows; further columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.llm.staging import WORD, small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- costs and states -------------------------------------------------------------------

RANK_KEEP, RANK_REROLE, RANK_DELETE, RANK_INSERT = "K", "R", "D", "I"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1  # fixed values: costs
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
# fixed values: where a role leads from a state; the conversation may end after START, AFTER_A
LEADS = {
    "s": {START: AFTER_S},
    "u": {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U},
    "a": {AFTER_U: AFTER_A},
}
ROLES = {"u": "user", "a": "assistant"}
# symbols of rows: role class x (sound, truncated), and the row that must go
MUST_GO = 8
N_SYMBOLS = 9
NO_WAY = 1 << 60


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    if must_go:
        return MUST_GO
    return 2 * "sua".find(initial) + truncated if initial in ("s", "u", "a") else 6 + truncated


def inserts(state: int) -> Iterator[tuple[int, int]]:
    """(number of inserted turns, state after them); a third would only repeat a state."""
    yield 0, state
    for n in (1, 2):
        state = AFTER_A if state == AFTER_U else AFTER_U
        yield n, state


@dataclass
class Matrix:
    """cost[p][q], rank[p][q] of the audit among those from p, and how to spell the audit.

    A symbol's entries spell themselves (`spelt`); a rule's are those of its left side from
    p to `middle[p][q]` and of its right side on from there.
    """

    cost: list[list[int]]
    rank: list[list[int]]
    spelt: list[list[str]] | None = None
    left: int = -1
    right: int = -1
    middle: list[list[int]] | None = None


def _ranks(keys: dict[int, object]) -> list[int]:
    places = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return [places[keys[q]] if q in keys else 0 for q in STATES]


def symbol_matrix(code: int) -> Matrix:
    truncated = code % 2 == 1
    initial = "sua "[code // 2] if code != MUST_GO else ""
    cost, rank, spelt = [], [], []
    for p in STATES:
        best: dict[int, tuple[int, str]] = {}
        for n, at in inserts(p):
            ways = [(DELETE, RANK_DELETE, at)]
            if code != MUST_GO:
                ways += [
                    (REROLE + truncated, RANK_REROLE, LEADS[role][at])
                    for role in ROLES if at in LEADS[role]
                ]
                if at in LEADS.get(initial, {}):
                    ways.append((0 + truncated, RANK_KEEP, LEADS[initial][at]))
            for price, edit, q in ways:
                way = (INSERT * n + price, RANK_INSERT * n + edit)
                best[q] = min(best.get(q, way), way)
        cost.append([best[q][0] if q in best else NO_WAY for q in STATES])
        rank.append(_ranks({q: best[q][1] for q in best}))
        spelt.append([best[q][1] if q in best else "" for q in STATES])
    return Matrix(cost, rank, spelt)


def _step(cost: list[int], rank: list[int], m: Matrix) -> tuple[list[int], list[int], list[int]]:
    """Costs, ranks and middle states of a row of entries times a matrix."""
    costs, middles, keys = [], [], {}
    for q in STATES:
        best = min((cost[k] + m.cost[k][q], rank[k], k) for k in STATES)
        if best[0] < NO_WAY:
            keys[q] = (best[1], m.rank[best[2]][q])
        costs.append(min(best[0], NO_WAY))
        middles.append(best[2])
    return costs, _ranks(keys), middles


def product(left: int, right: int, matrices: list[Matrix]) -> Matrix:
    rows = [_step(c, r, matrices[right]) for c, r in zip(matrices[left].cost, matrices[left].rank)]
    cost, rank, middle = map(list, zip(*rows))
    return Matrix(cost, rank, None, left, right, middle)


@dataclass
class Grammar:
    """Rules in rounds: rule i, numbered after the symbols, stands for a pair of earlier ones."""

    rounds: list[dict[tuple[int, int], int]]

    def matrices(self) -> list[Matrix]:
        out = [symbol_matrix(code) for code in range(N_SYMBOLS)]
        for rules in self.rounds:
            for (left, right), _ in sorted(rules.items(), key=lambda x: x[1]):
                out.append(product(left, right, out))
        return out

    def compress(self, sequence: list[int]) -> list[int]:
        for rules in self.rounds:
            if len(sequence) < 2:
                break
            out, i, last = [], 0, len(sequence) - 1
            while i < last:
                rule = rules.get((sequence[i], sequence[i + 1]))
                if rule is None:
                    out.append(sequence[i])
                    i += 1
                else:
                    out.append(rule)
                    i += 2
            if i == last:
                out.append(sequence[i])
            sequence = out
        return sequence


class Solver:
    """Cheapest audits of symbol sequences."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.matrices = grammar.matrices()
        self.known: dict[tuple[int, int, int], str] = {}

    def spell(self, code: int, p: int, q: int) -> str:
        """The audit of an entry, from its rope."""
        found = self.known.get((code, p, q))
        if found is None:
            m = self.matrices[code]
            if m.spelt is not None:
                found = m.spelt[p][q]
            else:
                k = m.middle[p][q]
                found = self.spell(m.left, p, k) + self.spell(m.right, k, q)
            self.known[(code, p, q)] = found
        return found

    def solve(self, sequence: bytes) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair."""
        codes = self.grammar.compress(list(sequence))
        cost, rank = [0, NO_WAY, NO_WAY, NO_WAY], [0, 0, 0, 0]
        steps = bytearray()
        for code in codes:
            cost, rank, middles = _step(cost, rank, self.matrices[code])
            steps += bytes(middles)
        ends = {START: 0, AFTER_S: 2, AFTER_U: 1, AFTER_A: 0}
        total, _, n, q = min((cost[q] + INSERT * n, rank[q], n, q) for q, n in ends.items())
        parts = [RANK_INSERT * n]
        for i in range(len(codes) - 1, -1, -1):
            k = steps[4 * i + q]
            parts.append(self.spell(codes[i], k, q))
            q = k
        return total, "".join(reversed(parts))


# --- the grammar, counted by Spark ------------------------------------------------------


@dataclass(frozen=True)
class GrammarParams:
    rounds: int = 16
    least_count: int = 2
    # matrices go to every task, some 0.5 KB each; rules beyond only share less
    most_rules: int = 4096


def pair_counts(sequence: list[int]) -> Counter:
    """How often each pair occurs, without overlaps of a pair with itself."""
    counts, i = Counter(), 0
    while i + 1 < len(sequence):
        pair = (sequence[i], sequence[i + 1])
        counts[pair] += 1
        if pair[0] == pair[1] and i + 2 < len(sequence) and sequence[i + 2] == pair[0]:
            i += 1  # the second of three equal symbols opens no pair with the third
        i += 1
    return counts


def choose(counted: list[tuple[int, int, int]], first_rule: int) -> dict[tuple[int, int], int]:
    """Pairs of a round, most frequent first, that cannot overlap one another."""
    sides: dict[int, str] = {}
    rules: dict[tuple[int, int], int] = {}
    for left, right, _ in counted:
        if left == right:
            fits = left not in sides
            wanted = {left: "both"}
        else:
            fits = sides.get(left, "left") == "left" and sides.get(right, "right") == "right"
            wanted = {left: "left", right: "right"}
        if fits:
            sides.update(wanted)
            rules[(left, right)] = first_rule + len(rules)
    return rules


def re_pair(sequences: DataFrame, params: GrammarParams = GrammarParams()) -> Grammar:
    """The grammar of a table of distinct sequences (column `sequence`, a byte a symbol)."""
    grammar = Grammar([])
    n_rules = 0
    while len(grammar.rounds) < params.rounds and n_rules < params.most_rules:

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = Counter()
            for batch in batches:
                for x in batch.column("sequence"):
                    counts.update(pair_counts(grammar.compress(list(x.as_py()))))
            left, right = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(right, pa.int32()),
                 pa.array(counts.values(), pa.int64())],
                names=["left", "right", "n"],
            )

        counted = (
            sequences.mapInArrow(pairs, "left int, right int, n long")
            .groupBy("left", "right").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= params.least_count)
            .orderBy(F.desc("n"), "left", "right").limit(params.most_rules - n_rules)
        )
        rules = choose([tuple(r) for r in counted.collect()], N_SYMBOLS + n_rules)
        if not rules:
            break
        n_rules += len(rules)
        grammar = Grammar([*grammar.rounds, rules])
    return grammar


def solved(sequences: DataFrame, grammar: Grammar) -> DataFrame:
    """Distinct sequences with the cost and audit of their cheapest repair."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(grammar)
        for batch in batches:
            found = [solver.solve(x.as_py()) for x in batch.column("sequence")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence"), pa.array([c for c, _ in found], pa.int64()),
                 pa.array([a for _, a in found], pa.string())],
                names=["sequence", "cost", "audit"],
            )

    return sequences.mapInArrow(solve, "sequence binary, cost long, audit string")


# --- rows -------------------------------------------------------------------------------

LAST_LETTER_ENDS = r"[.!?][\x20\x09-\x0D]*\z"
_ORDER = ["conv_id", "turn", "role", "text_key"]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `lost` of every row after the damage; lost rows stay.

    By the remainder of the key's CRC-32 by 20: 0 loses the row, 1 empties its text, 2 takes
    out its sentence ends, 3 repeats it, 4 gives it to the user.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
        kind.alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")
    ).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        (F.col("kind") == 0).alias("lost"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("i"),
    ).drop("i")


def marked(rows: DataFrame) -> DataFrame:
    """Rows with the marks that need no other row, and the digest that stands for the text."""
    return rows.select(
        "*", F.unhex(F.sha2("text", 256)).alias("text_key"),
        (~F.rlike("text", F.lit(WORD))).alias("blank"),
        (~F.rlike("text", F.lit(LAST_LETTER_ENDS))).alias("truncated"),
    )


def repeats(rows: DataFrame) -> DataFrame:
    """(conv_id, role, text_key) that occur at several turns, with the first of them."""
    return (
        rows.filter("not lost").groupBy("conv_id", "role", "text_key")
        .agg(
            # nulls come first
            F.min("turn").alias("least"), F.max("turn").alias("most"),
            F.max(F.col("turn").isNull()).alias("has_null"),
        )
        .filter("least < most or (has_null and least is not null)")
        .select(
            F.col("conv_id").alias("r_conv"), F.col("role").alias("r_role"),
            F.col("text_key").alias("r_key"),
            F.when(F.col("has_null"), None).otherwise(F.col("least")).alias("first_turn"),
            F.lit(True).alias("repeated"),
        )
    )


_STATS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("gaps", T.LongType()),
    T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()),
    T.StructField("truncated", T.LongType()), T.StructField("illegal", T.LongType()),
    T.StructField("sequence", T.BinaryType()),
])


class _Conversation:
    """What is counted while the rows of one conversation go by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = self.before = None
        self.sequence = bytearray()

    def add(self, turn, initial, key, blank, truncated, seen) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        if self.initial is not None:
            self.illegal += (self.initial + initial) not in ("su", "ua", "au")
        seen = seen or (turn, key) == self.before
        self.initial, self.before = initial, (turn, key)
        self.blank += blank
        self.duplicate += not blank and seen
        truncated = truncated and not blank and not seen
        self.truncated += truncated
        self.sequence.append(symbol(initial, blank or seen, truncated))

    def row(self) -> tuple:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                bytes(self.sequence))


def _rows_out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _columns(batch: pa.RecordBatch, *names: str) -> zip:
    return zip(*(batch.column(n).to_pylist() for n in names))


_STATS_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("sequence", pa.binary()),
])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows that come conversation by conversation, in order."""
    current, done = None, []
    for batch in batches:
        for conv, turn, role, key, lost, blank, truncated, seen in _columns(
            batch, "conv_id", "turn", "role", "text_key", "lost", "blank", "truncated", "seen"
        ):
            if current is None or conv != current.conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv)
            if not lost:
                current.add(turn, role[:1], (role, key), blank, truncated, seen)
        if len(done) > 1000:
            yield _rows_out(done, _STATS_ARROW)
            done = []
    if current is not None:
        done.append(current.row())
    yield _rows_out(done, _STATS_ARROW)


def statistics(conversations: DataFrame) -> DataFrame:
    """Counts and symbol sequence of every conversation; no text leaves its row."""
    rows = marked(damaged(conversations)).drop("text")
    again = small(written(repeats(rows), "repair-repeats"), 100_000)
    same = (
        rows["conv_id"].eqNullSafe(again["r_conv"]) & (rows["role"] == again["r_role"])
        & (rows["text_key"] == again["r_key"])
    )
    # the first turn of a repeated text is not seen before, unless it stands there twice
    seen = F.coalesce(F.col("repeated") & ~F.col("turn").eqNullSafe(F.col("first_turn")), F.lit(False))
    return (
        rows.join(again, same, "left")
        .select("conv_id", "turn", "role", "text_key", "lost", "blank", "truncated", seen.alias("seen"))
        .repartition("conv_id").sortWithinPartitions(*_ORDER)
        .mapInArrow(_count, _STATS)
    )


_HASHED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_REPAIRED = T.StructType(
    [T.StructField(n, T.LongType()) for n in _HASHED]
    + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
)
_REPAIRED_ARROW = pa.schema(
    [(n, pa.int64()) for n in _HASHED] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


class _Writer:
    """Applies an audit to the rows of a conversation as they go by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.initial, self.empty = audit, 0, "", True
        self.written = []

    def _write(self, role: str, text: str) -> None:
        self.initial = role[:1]
        self.written.append((role, text))

    def _following(self) -> str:
        return ROLES["a" if self.initial == "u" else "u"]

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == RANK_INSERT:
            self._write(self._following(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == RANK_KEEP:
            self._write(role, text)
        elif edit == RANK_REROLE:
            self._write(self._following(), text)

    def take(self, end: bool = False) -> list[tuple[str, str]]:
        if end:
            self._insert()
        out, self.written = self.written, []
        return out


def repaired_turns(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    writer = _Writer(audit)
    for role, text in rows:
        writer.row(role, text)
    return writer.take(end=True)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation follow a row that holds its counts and audit."""
    head, writer, digest, lines, done = None, None, None, 0, []

    def feed(end: bool = False) -> None:
        nonlocal lines
        for role, text in writer.take(end):
            digest.update(("\n" if lines else "").encode() + f"{role}:{text}".encode())
            lines += 1

    for batch in batches:
        names = [*_HASHED, "audit"]
        for is_row, role, text, *rest in _columns(batch, "is_row", "role", "text", *names):
            if is_row:
                writer.row(role, text)
                feed()
                continue
            if head is not None:
                feed(end=True)
                done.append((*head, digest.hexdigest()))
            head, writer, digest, lines = rest, _Writer(rest[-1]), hashlib.sha256(), 0
        if len(done) > 1000:
            yield _rows_out(done, _REPAIRED_ARROW)
            done = []
    if head is not None:
        feed(end=True)
        done.append((*head, digest.hexdigest()))
    yield _rows_out(done, _REPAIRED_ARROW)


def repaired(conversations: DataFrame, params: GrammarParams = GrammarParams()) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256."""
    stats = written(statistics(conversations), "repair-statistics")
    sequences = written(stats.select("sequence").distinct(), "repair-sequences")
    ways = written(solved(sequences, re_pair(sequences, params)), "repair-ways")
    heads = stats.join(small(ways, 100_000), "sequence").drop("sequence")
    rows = marked(damaged(conversations)).filter("not lost").select(
        "conv_id", F.lit(True).alias("is_row"), "turn", "role", "text_key", "text",
        *[F.lit(None).cast("long").alias(n) for n in _HASHED[1:]],
        F.lit(None).cast("string").alias("audit"),
    )
    heads = heads.select(
        "conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit(None).cast("binary").alias("text_key"),
        F.lit("").alias("text"), *_HASHED[1:], "audit",
    )
    return (
        rows.union(heads).repartition("conv_id")
        .sortWithinPartitions("conv_id", "is_row", "turn", "role", "text_key")
        .mapInArrow(_hash, _REPAIRED)
    )
