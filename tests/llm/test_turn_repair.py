"""Repairs against a plain search over all edits, and the grammar against its text."""

import hashlib
import random
import re
import zlib

from mailscreen.llm import turn_repair
from tests.llm.odd import clashing, rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
WANTED = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """Cheapest (cost, audit) by the plain table of all ways, without grammar or matrices."""
    def state(written):
        return written[:1] + "|" + written[-1:] if written else ""

    def offer(table, written, way):
        key = state(written)
        if key not in table or way < table[key][0]:
            table[key] = (way, written)

    table = {"": ((0, ""), "")}
    for initial, must_go, cut in symbols:
        following = {}
        for way, written in table.values():
            for inserted in ["", *["u" if written[-1:] != "u" else "a"],
                             *["ua" if written[-1:] != "u" else "au"]]:
                base = written + inserted
                if not allowed(base):
                    continue
                price, audit = way[0] + 2 * len(inserted), way[1] + "I" * len(inserted)
                offer(following, base, (price + 3, audit + "D"))
                if must_go:
                    continue
                for role in "ua":
                    if allowed(base + role):
                        offer(following, base + role, (price + 2 + cut, audit + "R"))
                if initial and allowed(base + initial):
                    offer(following, base + initial, (price + cut, audit + "K"))
        table = following
    done = []
    for way, written in table.values():
        for tail in ["", "a", "ua"]:
            if WANTED.fullmatch(written + tail):
                done.append((way[0] + 2 * len(tail), way[1] + "I" * len(tail)))
    return min(done)


def allowed(written):
    return re.fullmatch(r"s?(ua)*u?", written) is not None


def by_hand(rows):
    """Expected rows per conversation."""
    out, ids = [], {r[0] for r in rows}
    for conv in ids:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            role = "user" if kind == 4 else role
            turns += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(t[2].encode()).hexdigest()))
        seen, counts, symbols = set(), [0, 0, 0], []
        for _, role, text in turns:
            last = text.strip(" \t\n\v\f\r")[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            symbols.append((role[:1], fault in (0, 1), fault == 2))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit = cheapest(symbols)
        left, written = list(turns), []
        for edit in audit:
            nxt = "assistant" if written and written[-1][0][:1] == "u" else "user"
            if edit == "I":
                written.append((nxt, ""))
                continue
            _, role, text = left.pop(0)
            if edit != "D":
                written.append((role if edit == "K" else nxt, text))
        assert WANTED.fullmatch("".join(r[:1] for r, _ in written)) and not left
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def test_random_conversations(spark):
    draw = random.Random(3)
    roles = ["user", "assistant", "system", "u", "s", "tool", "", None, "User"]
    texts = ["Fine.", "No end", " \n", "", None, "Why?", "Fine. ", "a.b", "\x1c", "\U0001F600!"]
    rows = []
    for conv in [None, -3, *range(400)]:
        n = draw.randrange(0, 14) if conv != 7 else 600
        good = draw.random() < 0.5
        for turn in range(n):
            role = ["user", "assistant"][turn % 2] if good and draw.random() < 0.8 else draw.choice(roles)
            at = draw.choice([turn, turn, turn, turn + 2, 5, None])
            rows.append((conv, at, role, draw.choice(texts) if draw.random() < 0.5 else f"Turn {turn}."))
    draw.shuffle(rows)
    table = clashing(spark.createDataFrame(rows, SCHEMA), "audit", "is_row", "sequence", "seen")
    want = by_hand(rows)
    assert rows_of(turn_repair.repaired(table)) == want
    # the grammar only shares work
    for params in [turn_repair.GrammarParams(rounds=0), turn_repair.GrammarParams(rounds=2, most_rules=5)]:
        assert rows_of(turn_repair.repaired(table, params)) == want


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows_of(turn_repair.repaired(table)) == by_hand([tuple(r) for r in table.collect()])


def test_one_long_text_and_no_rows(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "x.")]
    assert rows_of(turn_repair.repaired(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)
    assert turn_repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_grammar_spells_its_text(spark):
    draw = random.Random(4)
    sequences = [bytes(draw.choice([2, 2, 4, 8, 5]) for _ in range(draw.randrange(0, 40))) for _ in range(300)]
    sequences.append(bytes([2] * 1001))
    table = spark.createDataFrame([(bytearray(s),) for s in set(sequences)], "sequence binary")
    grammar = turn_repair.re_pair(table)
    sides = {rule: pair for rules in grammar.rounds for pair, rule in rules.items()}
    assert len(grammar.rounds) > 3 and len(sides) == max(sides) - turn_repair.N_SYMBOLS + 1

    def spelt(code):
        return [code] if code not in sides else spelt(sides[code][0]) + spelt(sides[code][1])

    for s in sequences:
        short = grammar.compress(list(s))
        assert [x for code in short for x in spelt(code)] == list(s)
    assert len(grammar.compress([2] * 1001)) < 20
    solver, plain = turn_repair.Solver(grammar), turn_repair.Solver(turn_repair.Grammar([]))
    for s in sequences:
        assert solver.solve(s) == plain.solve(s)


def test_pair_counts():
    assert turn_repair.pair_counts([1, 1, 1, 1, 2, 1, 2]) == {(1, 1): 2, (1, 2): 2, (2, 1): 1}
    assert turn_repair.pair_counts([1, 1, 1]) == {(1, 1): 1}
    chosen = turn_repair.choose([(1, 2, 9), (2, 3, 8), (3, 2, 7), (4, 4, 6), (4, 2, 5)], 9)
    assert chosen == {(1, 2): 9, (3, 2): 10, (4, 4): 11}
