"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits, bit i set if it is set in over half of the hashes of the
text's shingles. Fingerprints link at `RADIUS` = 2 or fewer differing bits; a component is
what links reach.

Covering: bit i carries a vector m(i) of RADIUS + 1 bits, not zero, and table v, for each
of the 2^(RADIUS + 1) - 1 vectors v that are not zero, keeps the bits with odd <m(i), v>.
The vectors of two differing bits span at most two of three dimensions, so some v is
orthogonal to both, and in its table the pair has equal keys. No pair is missed.

Equal fingerprints are one class from the start, so copies never meet. In tables, buckets
with few fingerprints are compared member by member. Fingerprints of crowded buckets are
linked without pairs: each is filed under itself and its 64 neighbours at one differing
bit, where at most 65 can meet, all within two bits of each other, and a star links them.
Two fingerprints within two bits share such a neighbour, so nothing is capped or lost.

Components come from alternating large and small stars, every round a written table.

Defined results: null or empty texts and texts without words have fingerprint zero and
link like any other; very long texts are hashed whole, in blocks; null ids take part but are no component id unless all ids of the
component are null; repeated rows come back as often as they occur. Further columns of
the input are ignored by `components` and pass through `keep_one`.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.llm.staging import bundle, small, text_or_empty, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RADIUS = 2
SHINGLE = 3
SEED = 42
# buckets of at most so many fingerprints are compared member by member
COMPARED = 16
# Tables of at most so many (id, hash) rows are broadcast: some 20 MB.
SMALL_ROWS = 300_000
_BLOCK = 1 << 16
_BIT_OF_BYTE = np.unpackbits(
    np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little"
).astype(np.int64)
_BYTE_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's shingles, unsigned."""
    # bytes.lower touches A to Z alone, bytes.split parts at space and U+0009 to U+000D
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros((8, 8), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        hashes = np.array(
            [digest(b" ".join(words[i : i + SHINGLE]), SEED)
             for i in range(start, min(n, start + _BLOCK))],
            dtype="<u8",
        )
        cells = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS
        per_byte = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
        counts += per_byte @ _BIT_OF_BYTE
    bits = (2 * counts > n).ravel()
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def simhash(column: pa.Array) -> pa.Array:
    values = np.array([fingerprint(x.as_py() or "") for x in column], dtype=np.uint64)
    return pa.array(values.view(np.int64))


def masks() -> list[int]:
    """The bits that each table keeps, as signed 64-bit numbers."""
    vectors = 2 ** (RADIUS + 1)
    out = []
    for v in range(1, vectors):
        kept = sum(1 << i for i in range(64) if ((i % (vectors - 1) + 1) & v).bit_count() % 2)
        out.append(kept - (1 << 64) if kept >> 63 else kept)
    return out


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= RADIUS


def links(prints: DataFrame) -> DataFrame:
    """(a, b), a < b: links that connect all distinct fingerprints within the radius.

    In crowded buckets a star stands for its pairs; elsewhere each link is listed.
    """
    tables = F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks())
    ])
    filed = prints.select("fp", F.explode(tables).alias("t")).select("fp", "t.*")
    buckets = written(
        filed.groupBy("table", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .filter("n > 1"),
        "simhash-buckets",
    )
    twos = buckets.filter("n = 2").select("a", "b").filter(_close(F.col("a"), F.col("b")))

    fuller = small(buckets.filter("n > 2").select("table", "key", "n"), SMALL_ROWS)
    members = written(filed.join(fuller, ["table", "key"]), "simhash-members")
    listed = (
        members.filter(F.col("n") <= COMPARED)
        .groupBy("table", "key").agg(F.array_sort(F.collect_set("fp")).alias("fps"))
        .select(F.explode(F.flatten(F.transform(
            "fps",
            lambda x: F.transform(
                F.filter("fps", lambda y: (y > x) & _close(x, y)),
                lambda y: F.struct(x.alias("a"), y.alias("b")),
            ),
        ))).alias("link"))
        .select("link.*")
    )
    crowded = members.filter(F.col("n") > COMPARED).select("fp").distinct()
    near = F.array(F.col("fp"), *[
        F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i))
        for i in range(64)
    ])
    stars = (
        crowded.select("fp", F.explode(near).alias("centre"))
        .groupBy("centre").agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .filter("a <> b")
    )
    return twos.union(listed).union(stars).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is its least node.

    Large star: each node's larger neighbours move to its least neighbour. Small star: the
    smaller neighbours and the node itself do. Both keep the components, and end in stars.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "star-links"
    )
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = written(large, "star-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = (
            large.join(least, "u").filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = written(small_star, "star-small")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp of every row."""
    return docs.select(
        "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), simhash("text").alias("fp")
    )


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, fingerprint in hex, component_id."""
    rows = written(fingerprints(docs), "simhash-prints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    reached = written(connected(links(classes)), "simhash-roots")
    # ids of linked classes only; every other class is its own component
    ids = (
        reached.join(classes, reached["node"] == classes["fp"])
        .groupBy("root").agg(F.min("first_id").alias("linked_id"))
    )
    linked = reached.join(ids, "root").select(F.col("node").alias("fp"), "root", "linked_id")
    known = classes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.coalesce("linked_id", "first_id").alias("component_id"),
    )
    # read anew, so that both sides of the last join are dealt out for it and a
    # fingerprint that many documents share can be split
    known = written(known, "simhash-known")
    return rows.join(known, "fp").select(
        "doc_id", "text_hash", "root",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, whole rows, with one of each component: that of the smallest id.

    Of rows with that id, the one with the smallest text hash stays; null ids come last.
    """
    found = written(components(docs), "simhash-components")
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(rank).alias("w"), F.count(F.lit(1)).alias("n"))
    # copies only; a component of one document has no loser
    several = first.filter("n > 1").select("root", "w")
    chosen = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (
        F.col("text_hash") == F.col("w.text_hash")
    )
    copies = written(
        found.join(several, "root").select("doc_id", "text_hash", chosen.alias("chosen")),
        "simhash-copies",
    )
    losers = copies.filter("not chosen").select(
        F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")
    ).distinct()
    losers = small(losers, SMALL_ROWS)
    lost = docs["doc_id"].eqNullSafe(losers["lost_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == losers["lost_hash"]
    )
    kept = docs.join(losers, lost, "left_anti")
    winners = copies.filter("chosen")
    if winners.count() > winners.distinct().count():  # rows equal in id and text
        kept = kept.select("doc_id", F.xxhash64(text_or_empty()).alias("hash"), bundle(kept))
        kept = kept.dropDuplicates(["doc_id", "hash"]).select("document.*")
    return kept
