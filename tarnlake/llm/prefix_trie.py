"""Prefix trie of conversations, family first.

A family is the conversations of one base id.  Each is rebuilt from the first turns of the
base conversation and its own further turns.  A node stands for a sequence of turns and is
known by a 128-bit digest chained from its parent's, so families find their common nodes by
an equality.

1. Turns (digests and numbers of words, no texts) are cogrouped by base id: one shuffle, and
   a sort within tasks that keeps a family together, its base conversation first.  A task
   reads its families one after another, rebuilds them and builds each one's small trie;
   node rows with the family's counts leave it.
2. Only these are shuffled by node.  A node that one family has is final: so is everything
   below it.  Nodes that several families have are merged, and only for them are sums over
   subtrees taken across families: what hangs below them in one family comes as one number,
   and the rest is added up by pointer doubling, in as many rounds as their depth has bits.
3. The ids that end in a common node are sorted by range, joined in chunks by many tasks and
   hashed chunk by chunk.

A family with more than FAMILY_TURNS turns is not built in memory: the turns of its
conversations stream through as single node rows, and stage 2 treats its nodes as common.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, attach, written

FAMILY = 20
#: Families of more turns are not held in memory; a turn takes about 200 bytes there.
FAMILY_TURNS = 200_000
CHUNK_IDS = 10_000
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = b"\0" * 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "key binary, parent binary, depth long, conv long, parent_conv long, n_convs long, words long, n_children long, n_leaves long, saved long, ends array<long>, streamed boolean"
_NODE = pa.schema([("key", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv", "parent_conv", "n_convs", "words", "n_children", "n_leaves", "saved")), ("ends", pa.list_(pa.int64())), ("streamed", pa.bool_())])


def borrowed_turns(conv: int) -> int:
    """How many first turns a conversation takes from its base."""
    return zlib.crc32(str(conv).encode()) % 4


MOST_BORROWED = 3


@dataclass
class Node:
    parent: bytes
    depth: int
    conv: int
    words: int
    n_convs: int = 0
    children: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)


def _chain(parent: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(parent + turn, digest_size=16).digest()


class Family:
    """One family's conversations in the order of their ids, the base (if it is there) first."""

    def __init__(self, base: int, most_turns: int):
        self.base, self.most_turns = base, most_turns
        self.first: list[tuple[bytes, int]] = []  # the base's first turns
        self.nodes: dict[bytes, Node] | None = {}  # None: streamed
        self.pending: tuple | None = None  # streamed: the node that the conversation stands on
        self.turns = 0
        self.conv: int | None = None

    def begin(self, conv: int) -> Iterator[tuple]:
        if self.conv is not None:
            yield from self.end()
        self.conv, self.seen, self.at, self.depth = conv, 0, ROOT, 0
        yield from self._step(ROOT, None, 0)
        if conv != self.base:
            for turn, words in self.first[: borrowed_turns(conv)]:
                yield from self._turn(turn, words)

    def add(self, turn: bytes, words: int) -> Iterator[tuple]:
        """The next of the conversation's own turns."""
        self.seen += 1
        if self.conv == self.base:
            if self.seen <= MOST_BORROWED:
                self.first.append((turn, words))
            yield from self._turn(turn, words)
        elif self.seen > borrowed_turns(self.conv):
            yield from self._turn(turn, words)

    def end(self) -> Iterator[tuple]:
        if self.nodes is None:
            yield self.pending + ([self.conv], True)
            self.pending = None
        else:
            self.nodes[self.at].ends.append(self.conv)

    def _turn(self, turn: bytes, words: int) -> Iterator[tuple]:
        above = self.at
        self.at, self.depth = _chain(above, turn), self.depth + 1
        yield from self._step(self.at, above, words)

    def _step(self, key: bytes, parent: bytes | None, words: int) -> Iterator[tuple]:
        self.turns += 1
        if self.nodes is not None and self.turns > self.most_turns:
            yield from self._let_go()
        if self.nodes is None:
            if self.pending is not None:
                yield self.pending + ([], True)
            self.pending = self._single(key, parent, self.depth, self.conv, 1, words)
            return
        n = self.nodes.get(key)
        if n is None:
            n = self.nodes[key] = Node(parent, self.depth, self.conv, words)
            if parent is not None:
                self.nodes[parent].children.append(key)
        n.n_convs += 1
        n.conv = min(n.conv, self.conv)

    @staticmethod
    def _single(key, parent, depth, conv, n_convs, words) -> tuple:
        return (key, parent, depth, conv, None, n_convs, words, None, None, None)

    def _let_go(self) -> Iterator[tuple]:
        """From here on the family is streamed; what has been built leaves."""
        nodes, self.nodes = self.nodes, None
        for key, n in nodes.items():
            yield self._single(key, n.parent, n.depth, n.conv, n.n_convs, n.words) + (sorted(n.ends), True)

    def close(self) -> Iterator[tuple]:
        if self.conv is not None:
            yield from self.end()
        if self.nodes is None:
            return
        sums: dict[bytes, tuple[int, int]] = {}
        for key in reversed(self.nodes):  # children come after their parents
            n = self.nodes[key]
            below = [sums[c] for c in n.children]
            sums[key] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (n.n_convs - 1) * n.words)
        for key, n in self.nodes.items():
            yield (key, n.parent, n.depth, n.conv, self.nodes[n.parent].conv if n.parent is not None else None, n.n_convs, n.words, len(n.children), *sums[key], sorted(n.ends), False)


def family_nodes(turns: DataFrame, most_turns: int = FAMILY_TURNS) -> DataFrame:
    """Node rows (NODE) of each family; ``turns``: base, conv_id, at, digest, words, ... in any order.

    ``at`` null: first.  Turns of one place go by digest.
    """

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, rows = None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _NODE.types, strict=True)], schema=_NODE)
            rows.clear()
            return out

        for b in batches:
            for base, conv, digest, words in zip(*(b.column(c).to_pylist() for c in ("base", "conv_id", "digest", "words")), strict=True):
                if family is None or family.base != base:
                    if family is not None:
                        rows.extend(family.close())
                    family = Family(base, most_turns)
                if family.conv != conv:
                    rows.extend(family.begin(conv))
                rows.extend(family.add(digest, words))
                if len(rows) >= 10_000:
                    yield flush()
        if family is not None:
            rows.extend(family.close())
        if rows:
            yield flush()

    # The base goes before the others, whose ids may be smaller where ids are negative.
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("at"), "digest"]
    return turns.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "words").mapInArrow(built, NODE)


def turn_digests(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY) -> DataFrame:
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    # the role's length keeps (role, text) apart from other ways to cut the same letters
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.col(conv_col).cast("long")
    out = conversations.select(conv.alias("conv_id"), F.col(turn_col).alias("at"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    return out.filter(F.col("conv_id").isNotNull()).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)


def _merged(nodes: DataFrame) -> DataFrame:
    one = lambda c: F.max(c).alias(c)
    return nodes.groupBy("key").agg(F.count("*").alias("families"), F.bool_or("streamed").alias("streamed"), one("parent"), one("depth"), F.min("conv").alias("conv"), one("parent_conv"), F.sum("n_convs").alias("n_convs"), one("words"), one("n_children"), one("n_leaves"), one("saved"), one("ends"))


def _subtree_sums(common: DataFrame) -> DataFrame:
    """key, n_leaves, saved: own_leaves and own_saved added up over common nodes' subtrees."""
    state = written(common.select("key", F.col("parent").alias("up"), "depth", F.col("own_leaves").alias("n_leaves"), F.col("own_saved").alias("saved")), "sums")
    deepest = state.agg(F.max("depth")).head()[0] or 0
    step = 1
    while step <= deepest:
        # ``up`` is the node ``step`` above; a sum covers the nodes less than ``step`` below
        sent = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("askers"))
        grown = state.join(sent, "key", "left").select("key", "up", "depth", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("askers"))
        grown = written(grown, "sums")
        if 2 * step <= deepest:
            further = grown.filter(F.col("depth") >= 2 * step).drop("askers")
            tops = grown.filter(F.col("askers").isNotNull() & F.col("up").isNotNull()).select(F.col("key").alias("up"), F.col("up").alias("next"), "askers")
            moved = attach(further, tops, ["up"], "askers").select("key", F.col("next").alias("up"), "depth", "n_leaves", "saved")
            rest = grown.filter(F.col("depth") < 2 * step).select("key", F.lit(None).cast("binary").alias("up"), "depth", "n_leaves", "saved")
            state = written(moved.unionByName(rest), "sums")
        else:
            state = grown.drop("askers")
        step *= 2
    return state.select("key", "n_leaves", "saved")


def _hash_of_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 from (key, id): the ids in order, joined by commas."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["key", "first", "part"])

        for b in batches:
            for k, i in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= CHUNK_IDS):
                    yield out()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, found = None, None, []
        for b in batches:
            for k, part in zip(b.column("key").to_pylist(), b.column("part").to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        found.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256(part.encode())
                else:
                    h.update(b"," + part.encode())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found])], names=["key", "ends_sha256"])
                found = []
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    chunks = ends.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(chunked, "key binary, first long, part string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, most_turns: int = FAMILY_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, families of each node.

    Conversations are ordered by turn, null first; turns of one place (repeated rows too)
    go by the digest of (role, text).  A null role or text is empty.  Rows of a null
    conversation are left out; ids are read as long.  An empty table gives an empty one;
    other columns are ignored.  ``families``: how many families have the node (for streamed
    ones, how many of their conversations).
    """
    nodes = written(family_nodes(turn_digests(conversations, conv_col, turn_col, role_col, text_col, family), most_turns), "nodes")
    merged = written(_merged(nodes), "merged")
    is_common = (F.col("families") > 1) | F.col("streamed")
    own, common = merged.filter(~is_common), merged.filter(is_common)

    hung = own.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("own_children"), F.sum("n_leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    kids = common.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("common_children"))
    c = common.select("key", "parent", "depth", "conv", "n_convs", "words", "families").join(hung, "key", "left").join(kids, "key", "left").na.fill(0, ["own_children", "common_children", "hung_leaves", "hung_saved"])
    c = c.withColumn("n_children", F.col("own_children") + F.col("common_children"))
    leaf = (F.col("n_children") == 0).cast("long")
    c = written(c.withColumn("own_leaves", F.col("hung_leaves") + leaf).withColumn("own_saved", F.col("hung_saved") + (F.col("n_convs") - 1) * F.col("words")), "common")

    above = c.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("common_parent"), "n_children")
    place = lambda df: _attach_left(df, above, "parent", "n_children")
    found = attach(nodes.filter(F.size("ends") > 0).select("key", "ends"), c.select("key", "families"), ["key"], "families").select("key", F.explode("ends").alias("id"))
    ends = _hash_of_ends(found)
    top = place(c.select("key", "parent", "depth", "conv", "n_convs", F.col("n_children").alias("kids"), "families")).join(_subtree_sums(c), "key").join(ends, "key", "left")
    top = top.select("conv", "depth", F.col("common_parent").alias("parent_conv"), "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "families")
    low = place(own.select("parent", "depth", "conv", "parent_conv", "n_convs", F.col("n_children").alias("kids"), "n_leaves", "saved", "ends", "families"))
    low = low.select("conv", "depth", F.coalesce("common_parent", "parent_conv").alias("parent_conv"), "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved", F.sha2(F.concat_ws(",", F.col("ends").cast("array<string>")), 256).alias("ends_sha256"), "families")
    out = top.unionByName(low)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256", "families")


def _attach_left(rows: DataFrame, facts: DataFrame, key: str, size_col: str) -> DataFrame:
    """Left join with ``facts`` (a row for each key, ``size_col`` rows have it); keys of very many rows go by broadcast."""
    total = facts.agg(F.sum(size_col)).head()[0] or 0
    hot = F.col(size_col) > total / MOST_BROADCAST
    few = F.broadcast(facts.filter(hot))
    rest = rows.join(few.select(key), key, "left_anti").join(facts.filter(~hot), key, "left")
    return rows.join(few, key).unionByName(rest)
