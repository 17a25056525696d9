import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from mailscreen.llm import simhash
from tests.llm.odd import PLAIN, clashing, empty_docs, odd_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(nodes)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_every_pair_within_the_radius_shares_a_table():
    masks = simhash.masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            differing = 1 << i | 1 << j
            assert any(m & differing == 0 for m in masks)


def test_odd_documents(spark):
    docs = clashing(odd_docs(spark), "fp", "root", "text_hash", "table", "key", "n", "node")
    got = simhash.components(docs).collect()
    assert len(got) == docs.count()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {plain_fingerprint(t) for _, t in rows}
    root = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            r = root[plain_fingerprint(t)]
            least[r] = min(least.get(r, i), i)
    expected = sorted(
        (repr(i), f"{plain_fingerprint(t):016x}", least[root[plain_fingerprint(t)]]) for i, t in rows
    )
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected


@pytest.mark.parametrize("compared", [0, 3, 16])
def test_links_connect_what_is_near(spark, monkeypatch, compared):
    """Also where buckets are crowded: many fingerprints around few centres."""
    monkeypatch.setattr(simhash, "COMPARED", compared)
    draw = random.Random(compared)
    prints = set()
    for _ in range(3):
        centre = draw.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(draw.randrange(0, 5)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    edges = simhash.links(frame)
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2
    got = {r.node: r.root for r in simhash.connected(edges).collect()}
    root = reachable(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for x in prints:
        groups.setdefault(root[x], set()).add(signed(x))
    found = {}
    for node, r in got.items():
        found.setdefault(r, set()).add(node)
    assert sorted(map(sorted, found.values())) == sorted(
        sorted(g) for g in groups.values() if len(g) > 1
    )


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = simhash.connected(edges).collect()
    assert len(roots) == 301 and {r.root for r in roots} == {0}


def test_keep_one(spark):
    docs = clashing(odd_docs(spark), "root", "lost_id", "hash", "document", "chosen")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {(r.root, r.component_id) for r in simhash.components(docs).collect()}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(c for _, c in groups)
    copies = spark.createDataFrame([(2, PLAIN), (2, PLAIN), (3, PLAIN)], "doc_id long, text string")
    assert [tuple(r) for r in simhash.keep_one(copies).collect()] == [(2, PLAIN)]


def test_no_documents(spark):
    assert simhash.components(empty_docs(spark)).count() == 0
    assert simhash.keep_one(empty_docs(spark)).count() == 0
