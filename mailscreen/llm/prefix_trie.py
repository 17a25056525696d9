"""Prefix trie of conversations by a skeleton of range-partition splitters.

Every conversation is rebuilt from the opening of another one, and stands for the path of
its turns. A turn is a 16-byte digest of role and text, a path the digests in a row, so
texts never travel. Paths in byte order, copies by id, are cut into shards at splitters:
separators taken from a bounded, evenly drawn sample, each the shortest path that keeps
apart its two neighbours in the sample. If two shards share a node, its path begins the
splitter between them. The trie of all splitters, the skeleton, is therefore broadcast, and
every node outside it lies in one shard. A shard is sorted and read once, holding the nodes of
the path at hand and the finished children of these; nodes outside the skeleton are done
there, nodes of the skeleton leave one partial aggregate per shard. Partial aggregates are
summed by Spark, rolled up along the skeleton (as large as the splitters, not as the
data), and joined to the children that wait for their parent's id.

A shard holds some `per_shard` turns, and copies of one conversation are spread over as many
shards as they need, so no group has to fit into a task. The path of one conversation, 16
bytes a turn, has to. Ids of members that end in a skeleton node are joined to
text runs inside the shards; these runs, not ids, are hashed in order.

Defined results: turns come by number (null first; ties by role, then by the digest of the
text); null roles and texts are empty; rows without conv_id belong to no conversation and are
left out; repeated rows are turns of their own; conversations of which no turn is left are
members of the root alone; without conversations there is no node, not even the root;
further columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailscreen.llm.staging import small, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGEST = 16  # bytes a turn has in a path
# fixed values of how conversations are rebuilt
HUNDRED, OPENINGS = 100, 6
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class TrieParams:
    # turns in a shard, about; and bounds on the number of shards
    per_shard: int = 50_000
    least_shards: int = 16
    most_shards: int = 16_384
    # paths drawn for each shard
    sample: int = 8
    # members' ids in one text run
    run_length: int = 8192


# --- rebuilt conversations --------------------------------------------------------------


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: digest and code points of every turn, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(
        F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(" "), role, text), 256)),
        1, DIGEST,
    )
    turn = F.struct(
        "turn", role.alias("role"), digest.alias("digest"),
        F.char_length(text).cast("long").alias("length"),
    )
    ordered = F.sort_array(F.collect_list(turn))
    return (
        conversations.filter("conv_id is not null").groupBy("conv_id")
        .agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["length"])).alias("turns"))
    )


def opening_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % OPENINGS).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path, lengths: the first h turns of conversation c - c % 100 before c's own
    turns after its first h, where h is the CRC-32 of c modulo 6."""
    turns = written(turn_lists(conversations), "trie-turns")
    heads = turns.filter(F.col("conv_id") % HUNDRED == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, OPENINGS - 1).alias("opening")
    )
    heads = small(heads, 100_000)
    h = opening_length(F.col("conv_id"))
    own = F.slice("turns", h + 1, F.size("turns") + 1)
    none = F.array().cast(turns.schema["turns"].dataType)
    opening = F.slice(F.coalesce("opening", none), F.lit(1), h)
    whole = turns.join(heads, F.col("conv_id") - F.col("conv_id") % HUNDRED == F.col("head_id"), "left")
    return whole.select("conv_id", F.concat(opening, own).alias("turns")).select(
        "conv_id",
        F.coalesce(
            F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")),
            F.lit(b""),
        ).alias("path"),
        F.transform("turns", lambda t: t["length"]).alias("lengths"),
    )


# --- splitters and skeleton -------------------------------------------------------------


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with alike."""
    least, most = 0, min(len(a), len(b)) // DIGEST
    if a[: most * DIGEST] == b[: most * DIGEST]:
        return most
    while least < most:  # alike at least so many, at most so many
        middle = (least + most + 1) // 2
        if a[: middle * DIGEST] == b[: middle * DIGEST]:
            least = middle
        else:
            most = middle - 1
    return least


def separator(before: tuple[bytes, int], after: tuple[bytes, int]) -> tuple[bytes, int]:
    """The shortest key above `before` and not above `after`; copies are parted by id."""
    if before[0] == after[0]:
        return after
    return after[0][: (shared_turns(before[0], after[0]) + 1) * DIGEST], NO_ID


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.number: dict[bytes, int] = {b"": 0}
        self.parent = [-1]
        self.depth = [0]
        for path, _ in splitters:
            above = 0
            for d in range(1, len(path) // DIGEST + 1):
                prefix = path[: d * DIGEST]
                known = self.number.get(prefix)
                if known is None:
                    known = self.number[prefix] = len(self.parent)
                    self.parent.append(above)
                    self.depth.append(d)
                above = known

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))


def splitters(paths: DataFrame, params: TrieParams) -> list[tuple[bytes, int]]:
    """Separators at equal steps of a sample that is bounded by the number of shards."""
    turns = paths.agg(F.sum(F.size("lengths") + 1)).first()[0] or 0
    shards = max(params.least_shards, min(params.most_shards, -(-turns // params.per_shard)))
    drawn = (
        paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id")
        .limit(shards * params.sample).collect()
    )
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn)
    places = sorted({i * len(keys) // shards for i in range(1, shards)} - {0})
    return sorted({separator(keys[i - 1], keys[i]) for i in places})


# --- shards -----------------------------------------------------------------------------

# kinds of rows that a shard gives
NODE, PARTIAL, RUN = 0, 1, 2
_PIECE_ARROW = pa.schema([
    ("kind", pa.int32()), ("skeleton", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("length", pa.int64()),
    ("ends", pa.string()),
])
_PIECE = (
    "kind int, skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, length long, ends string"
)


class _Open:
    """A node of the path at hand, or what one shard knows of a skeleton node."""

    __slots__ = ("skeleton", "length", "conv_id", "n_convs", "n_children", "n_leaves",
                 "saved", "digest", "run", "waiting")

    def __init__(self, skeleton, length: int):
        self.skeleton, self.length = skeleton, length
        self.conv_id = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.digest = None  # of the ids of members that end here
        self.run: list[int] = []
        self.waiting: list[tuple] = []  # finished children that need this node's id


class Shards:
    """Reads sorted paths, one shard after another, and gives rows of the kinds above."""

    def __init__(self, skeleton: Skeleton, run_length: int):
        self.skeleton, self.run_length = skeleton, run_length
        self.shard, self.path, self.stack, self.out = None, b"", [], []

    def _flush(self, node: _Open) -> None:
        """Ids of a skeleton node leave as one run of text, other ids go into the hash."""
        text = ",".join(map(str, node.run))
        if node.skeleton is not None:
            self.out.append((RUN, node.skeleton, node.run[0], *[None] * 7, text))
        elif node.digest is None:
            node.digest = hashlib.sha256(text.encode())
        else:
            node.digest.update(f",{text}".encode())
        node.run = []

    def _close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        if node.run:
            self._flush(node)
        if node.skeleton is not None:
            self.out.append((PARTIAL, node.skeleton, node.conv_id, depth, None, node.n_convs,
                             node.n_children, node.n_leaves, node.saved, node.length, None))
            # its sums reach the nodes above along the skeleton
        else:
            leaves = node.n_leaves or 1  # no child left a leaf: it is one itself
            saved = node.saved + (node.n_convs - 1) * node.length
            digest = node.digest or hashlib.sha256()
            above = self.stack[-1]
            above.n_children += 1
            above.n_leaves += leaves
            above.saved += saved
            row = (node.conv_id, depth, node.n_convs, node.n_children, leaves, saved, digest.hexdigest())
            if above.skeleton is None:
                above.waiting.append(row)
            else:
                self._done(row, above.skeleton, None)
        for row in node.waiting:
            self._done(row, None, node.conv_id)

    def _done(self, row: tuple, skeleton, parent) -> None:
        conv_id, depth, n_convs, n_children, leaves, saved, digest = row
        self.out.append((NODE, skeleton, conv_id, depth, parent, n_convs, n_children, leaves,
                         saved, None, digest))

    def add(self, shard: int, path: bytes, conv_id: int, lengths: list[int]) -> None:
        if shard != self.shard:
            self.finish()
            self.shard, self.path = shard, b""
        keep = 1 + shared_turns(self.path, path) if self.stack else 0
        while len(self.stack) > keep:
            self._close()
        number = self.skeleton.number
        for depth in range(keep, len(lengths) + 1):
            # a node below one that is outside the skeleton is outside as well
            inside = depth == 0 or self.stack[-1].skeleton is not None
            skeleton = number.get(path[: depth * DIGEST]) if inside else None
            self.stack.append(_Open(skeleton, lengths[depth - 1] if depth else 0))
        for node in self.stack:
            node.n_convs += 1
            if node.conv_id is None or conv_id < node.conv_id:
                node.conv_id = conv_id
        last = self.stack[-1]
        last.run.append(conv_id)
        if len(last.run) >= self.run_length:
            self._flush(last)
        self.path = path

    def finish(self) -> None:
        while self.stack:
            self._close()

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = list(zip(*out)) if out else [()] * len(_PIECE_ARROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _PIECE_ARROW)], schema=_PIECE_ARROW
        )


def shard_rows(paths: DataFrame, skeleton: Skeleton, params: TrieParams) -> DataFrame:
    """What the shards give, in rows of three kinds."""
    shared = paths.sparkSession.sparkContext.broadcast(skeleton)

    @F.arrow_udf(T.IntegerType())
    def shard(path: pa.Array, conv_id: pa.Array) -> pa.Array:
        keys = zip(path.to_pylist(), conv_id.to_pylist())
        return pa.array([shared.value.shard(p, c) for p, c in keys], pa.int32())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(shared.value, params.run_length)
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("shard", "path", "conv_id", "lengths"))
            for row in zip(*columns):
                shards.add(*row)
            if len(shards.out) >= 4096:
                yield shards.take()
        shards.finish()
        yield shards.take()

    placed = paths.select(shard("path", "conv_id").alias("shard"), "path", "conv_id", "lengths")
    return (
        placed.repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
        .mapInArrow(read, _PIECE)
    )


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, ends_sha256) from text runs that come node by node, in order of ids."""
    node, digest, done = None, None, []
    for batch in batches:
        for skeleton, text in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if skeleton == node:
                digest.update(f",{text}".encode())
                continue
            if node is not None:
                done.append((node, digest.hexdigest()))
            node, digest = skeleton, hashlib.sha256(text.encode())
    if node is not None:
        done.append((node, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([n for n, _ in done], pa.int32()), pa.array([d for _, d in done], pa.string())],
        names=["skeleton", "ends_sha256"],
    )


def rolled_up(sums: dict[int, tuple], skeleton: Skeleton) -> list[tuple]:
    """Nodes of the skeleton from the sums of their partial aggregates, children first."""
    n = len(skeleton.parent)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    out = []
    for i in range(n - 1, -1, -1):  # a node is numbered after its parent
        conv_id, n_convs, own_children, own_leaves, own_saved, length = sums[i]
        children[i] += own_children
        leaves[i] = (leaves[i] + own_leaves) or 1
        saved[i] += own_saved + (n_convs - 1) * length
        above = skeleton.parent[i]
        if above >= 0:
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
        out.append((
            i, conv_id, skeleton.depth[i], sums[above][0] if above >= 0 else None, n_convs,
            children[i], leaves[i], saved[i],
        ))
    return out


_SKELETON = (
    "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long"
)
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
         "ends_sha256"]
_NO_IDS = hashlib.sha256(b"").hexdigest()


def trie(conversations: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark: SparkSession = conversations.sparkSession
    paths = written(rebuilt(conversations), "trie-paths")
    skeleton = Skeleton(splitters(paths, params))
    pieces = written(shard_rows(paths, skeleton, params), "trie-pieces")

    partial = (
        pieces.filter(F.col("kind") == PARTIAL).groupBy("skeleton")
        .agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"), F.max("length").alias("length"),
        )
    )
    sums = {r[0]: tuple(r)[1:] for r in partial.collect()}  # a row a skeleton node
    rows = rolled_up(sums, skeleton) if sums else []
    ends = (
        pieces.filter(F.col("kind") == RUN).select("skeleton", "conv_id", "ends")
        .repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
        .mapInArrow(_hash_runs, "skeleton int, ends_sha256 string")
    )
    upper = F.broadcast(spark.createDataFrame(rows, _SKELETON))  # bounded by the splitters
    inner = upper.join(ends, "skeleton", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_IDS))
    )
    parents = upper.select("skeleton", F.col("conv_id").alias("above"))
    outer = (
        pieces.filter(F.col("kind") == NODE).join(F.broadcast(parents), "skeleton", "left")
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        .withColumnRenamed("ends", "ends_sha256")
    )
    return outer.select(_NODE).union(inner.select(_NODE))
