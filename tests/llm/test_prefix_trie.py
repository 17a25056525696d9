"""Trie nodes against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from mailscreen.llm import prefix_trie
from mailscreen.llm.prefix_trie import DIGEST, NO_ID, Skeleton, TrieParams, separator, shared_turns
from tests.llm.odd import clashing, rows_of

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    lists = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            lists[conv].append((turn, role or "", text or ""))
    for turns in lists.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.sha256(
            f"{len(t[1])} {t[1]}{t[2]}".encode()).digest()))
    members, ends = defaultdict(list), defaultdict(list)
    for conv, turns in lists.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (abs(conv) % 100) * (1 if conv >= 0 else -1)
        path = [t[1:] for t in lists.get(base, [])[:h] + turns[h:]]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
        ends[tuple(path)].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    return sorted((
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]),
         leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    ), key=repr)


def table_of(seed, n, copies):
    draw = random.Random(seed)
    rows = []
    for conv in [None, -5, -100, *draw.sample(range(1500), n)]:
        for turn in range(draw.randrange(0, 7) if conv != 0 else 6):
            rows.append((conv, draw.choice([turn, turn, turn, None]), draw.choice(["user", "tool", "", None]),
                         draw.choice(["Hello", "é\U0001F600", "", None, "b" * 300])))
    for conv in range(2000, 2000 + copies):
        rows += [(conv, t, "user", f"One of many {t}") for t in range(9)]
    rows += [(9999, t, "user", f"Long {t}") for t in range(1500)] + rows[:3]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("params", [
    TrieParams(), TrieParams(per_shard=20, least_shards=3, sample=3, run_length=2),
    TrieParams(per_shard=10**9, least_shards=1), TrieParams(least_shards=400, sample=20, run_length=1),
])
def test_random_conversations(spark, params):
    rows = table_of(1, 300, 150)
    table = clashing(spark.createDataFrame(rows, SCHEMA), "path", "shard", "kind", "depth", "turns")
    assert rows_of(prefix_trie.trie(table, params)) == by_hand(rows)


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows_of(prefix_trie.trie(table)) == by_hand([tuple(r) for r in table.collect()])


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(none).count() == 0
    # one conversation loses all its turns, another has a very long text
    lost = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    for rows in [[(lost, 0, "user", "a")], [(lost, 0, "user", "a"), (100, 1, "user", "x" * 3_000_000)],
                 [(None, 0, "user", "a")]]:
        assert rows_of(prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))) == by_hand(rows)


def test_separators_part_their_neighbours():
    draw = random.Random(2)

    def path():
        return b"".join(bytes([draw.randrange(2)]) * DIGEST for _ in range(draw.randrange(0, 5)))

    keys = sorted((path(), draw.randrange(-9, 9)) for _ in range(500))
    for a, b in zip(keys, keys[1:]):
        s = separator(a, b)
        assert a == b or a < s <= b
        # a node that both have begins the separator
        n = shared_turns(a[0], b[0])
        assert s[0][: n * DIGEST] == a[0][: n * DIGEST]
    assert separator((b"", 1), (b"a" * 48, 2)) == (b"a" * 16, NO_ID)
    skeleton = Skeleton([(b"a" * 32, NO_ID), (b"a" * 16 + b"b" * 16, 7)])
    assert (skeleton.parent, skeleton.depth) == ([-1, 0, 1, 1], [0, 1, 2, 2])
    assert [skeleton.shard(b"a" * 16, 0), skeleton.shard(b"a" * 48, 0)] == [0, 1]
    assert [skeleton.shard(b"a" * 16 + b"b" * 16, i) for i in (6, 7, 8)] == [1, 2, 2]
