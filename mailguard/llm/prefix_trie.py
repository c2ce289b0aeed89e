"""Trie of the prefixes that conversations share (operator 12), by truncation peeling.

A conversation becomes the list of its turns' digests; a node is named by the
digest chained over its turns.  Conversations are range partitioned and sorted
by (digests, id), so those that share a prefix lie side by side, also when a
third of all are equal.  A task reads its part once.  It holds the nodes of the
current conversation only and peels them from the deepest one up: a node that
the next conversation does not share is finished, its last turn is stripped
and its figures merge into the node that survives, along with the
conversations that end there.  Regrouping by order instead of one shuffle per
depth keeps the number of Spark stages the same for a conversation of 5 and of
5,000 turns.

Nodes that go on over the edge of a task's part are reported by each task that
has members of them.  What a task adds is chosen so that the parts sum up: the
first task that has a node counts it as a child and pays for its text, the
last one knows whether it is a leaf.  For that a task needs two numbers, how
many turns its first and last conversation share with the neighbouring parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailguard.llm.common import cut, give_back
from mailguard.operators.joins import weighted_lookup

ROOT = ""           # name of the textless node
CHUNK = 1 << 16     # ids of a split node in one row
ROWS = 4096         # rows of a batch of nodes
NODE = ("key string, parent string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, ends string")
_OUT = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in NODE.split(", ")])


def sequences(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """``conv_id, turns``: one row per conversation, its turns in order as (``digest``, ``bytes`` of the text).

    Turns are ordered by ``order_col``, null first, ties by their digests; null
    role or text is empty.  Rows without an id are left out.  Digests of role
    and text take the place of the texts before any shuffle, so a conversation
    of any length is some 40 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat_ws(":", F.char_length(role), role, text).cast("binary")
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(F.col(order_col).alias("at"), F.md5(named).alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return (turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns")))


class _Node:
    """Figures of one node of the current conversation, as far as this task has seen it."""

    __slots__ = ("key", "depth", "size", "owned", "parent", "conv", "convs", "children", "leaves", "saved", "hash", "ends")

    def __init__(self, key: str, depth: int, size: int, owned: bool):
        self.key, self.depth, self.size, self.owned = key, depth, size, owned
        self.parent = False                       # whether a child was met here
        self.conv = self.hash = self.ends = None
        self.convs = self.children = self.leaves = self.saved = 0

    def add(self, conv: int, convs: int) -> None:
        self.convs += convs
        self.conv = conv if self.conv is None else min(self.conv, conv)


class _Peeler:
    """Peels the nodes of one sorted part; ``rows`` are those that are finished."""

    def __init__(self, before: int, after: int, split: tuple):
        self.before, self.after, self.split = before, after, split
        self.stack, self.path, self.rows, self.first = [_Node(ROOT, 0, 0, before < 0)], [], [], True

    def conversation(self, conv: int, own: list[str], sizes: list[int]) -> None:
        shared = 0
        for a, b in zip(self.path, own, strict=False):
            if a != b:
                break
            shared += 1
        while len(self.stack) > shared + 1:
            self.strip(-1)
        for d in range(shared, len(own)):
            top = self.stack[-1]
            top.parent = True
            key = hashlib.md5((top.key + own[d]).encode()).hexdigest()
            self.stack.append(_Node(key, d + 1, sizes[d], not (self.first and d + 1 <= self.before)))
        self.path, self.first = own, False
        self.ends_here(self.stack[-1], conv)

    def ends_here(self, node: _Node, conv: int) -> None:
        node.add(conv, 1)
        if node.key in self.split:                # other parts hold ids of this node as well
            node.ends = node.ends or []
            node.ends.append(conv)
            if len(node.ends) >= CHUNK:
                self.piece(node)
        elif node.hash is None:
            node.hash = hashlib.sha256(str(conv).encode())
        else:
            node.hash.update(f",{conv}".encode())

    def piece(self, node: _Node) -> None:
        self.rows.append((node.key, None, node.depth, node.ends[0], 0, 0, 0, 0, None, ",".join(map(str, node.ends))))
        node.ends = []

    def strip(self, goes_on: int) -> None:
        """Finish the deepest node and merge it into the node without its last turn.

        Nodes of at most ``goes_on`` turns have members in the next part."""
        node = self.stack.pop()
        if not node.parent and node.depth > goes_on:
            node.leaves = 1
        node.saved += node.size * (node.convs - node.owned)
        up = self.stack[-1] if self.stack else None
        sha = node.hash.hexdigest() if node.hash else None
        self.rows.append((node.key, up.key if up else None, node.depth, node.conv, node.convs, node.children,
                          node.leaves, node.saved, sha, None))
        if node.ends:
            self.piece(node)
        if up:
            up.add(node.conv, node.convs)
            up.children += node.owned
            up.leaves += node.leaves
            up.saved += node.saved

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _OUT.types, strict=True)], schema=_OUT)
        self.rows = []
        return batch


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``conv_id, path, sizes, before, after, prev_key, next_key`` of one part to its nodes."""
    peeler = None
    for batch in batches:
        ids, paths, sizes = (c.to_pylist() for c in batch.columns[:3])
        if peeler is None and ids:
            before, after, *split = (c[0].as_py() for c in batch.columns[3:])
            peeler = _Peeler(before, after, tuple(split))
        for conv, own, size in zip(ids, paths, sizes, strict=True):
            peeler.conversation(conv, own, size)
            if len(peeler.rows) >= ROWS:
                yield peeler.take()
    if peeler:
        while peeler.stack:
            peeler.strip(peeler.after)
        yield peeler.take()
    give_back()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, ends_sha256`` of pieces of ids that come sorted by key and id; one piece is held at a time."""
    at, state = None, None
    for batch in batches:
        done = []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key == at:
                state.update(b"," + ends.encode())
                continue
            if at is not None:
                done.append((at, state.hexdigest()))
            at, state = key, hashlib.sha256(ends.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["key", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def _shared(a: str, b: str) -> Column:
    """How many first elements two arrays have in common."""
    least = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.sequence(F.lit(1), least), lambda i: F.get(a, i - 1) != F.get(b, i - 1)), True)
    return F.when(least == 0, 0).otherwise(F.when(differs > 0, differs - 1).otherwise(least)).cast("int")


def _edges(ordered: DataFrame) -> DataFrame:
    """Per part: turns shared with the parts before and after it (-1: no such part), and its split nodes.

    One row per part that has rows, so the window and what is broadcast grow
    with the number of partitions only.
    """
    end = F.struct("path", "conv_id", "key")
    ends = ordered.groupBy("part").agg(F.min(end).alias("lo"), F.max(end).alias("hi"))
    by = Window.orderBy("part")
    near = (ends.withColumn("prev", F.lag("hi").over(by)).withColumn("next", F.lead("lo").over(by))
            .select("part", F.col("lo.path").alias("lo"), F.col("hi.path").alias("hi"), F.col("prev.path").alias("prev"),
                    F.col("next.path").alias("next"), F.col("lo.key").alias("lo_key"), F.col("hi.key").alias("hi_key"),
                    F.col("prev.key").alias("prev_key"), F.col("next.key").alias("next_key")))
    return near.select("part", F.when(F.col("prev").isNull(), -1).otherwise(_shared("prev", "lo")).alias("before"),
                       F.when(F.col("next").isNull(), -1).otherwise(_shared("hi", "next")).alias("after"),
                       F.when(F.col("prev_key") == F.col("lo_key"), F.col("lo_key")).alias("prev_key"),
                       F.when(F.col("next_key") == F.col("hi_key"), F.col("hi_key")).alias("next_key"))


def prefix_nodes(seqs: DataFrame) -> DataFrame:
    """Nodes of the trie over ``seqs`` (``conv_id, turns`` as ``sequences`` gives them, ids distinct and not null).

    One row per node: ``key, parent`` (names of the node and of the node
    without its last turn), ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` as the contract of the query has them.
    A conversation without turns is a member of the root alone; without
    conversations there are no nodes.  Equal conversations, however many, are
    dealt over several parts by their ids.  A hash of ids needs them in order:
    those that lie in several parts come together as strings of up to 65,536
    ids, one at a time.
    """
    chain = F.aggregate("path", F.lit(ROOT), lambda a, d: F.md5(F.concat(a, d).cast("binary")))
    rows = cut(seqs.select("conv_id", F.col("turns.digest").alias("path"), F.col("turns.bytes").alias("sizes")).withColumn("key", chain))
    ordered = cut(rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
                  .withColumn("part", F.spark_partition_id()))
    peeled = cut(ordered.drop("key").join(F.broadcast(_edges(ordered)), "part")
                 .select("conv_id", "path", "sizes", "before", "after", "prev_key", "next_key")
                 .mapInArrow(_peel, NODE))
    split = (peeled.where("ends is not null").repartition("key").sortWithinPartitions("key", "conv_id")
             .select("key", "ends").mapInArrow(_digest, "key string, ends_sha256 string")
             .withColumnRenamed("ends_sha256", "split_sha256"))
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = cut(peeled.where("ends is null").groupBy("key")
                .agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                     *total, F.max("ends_sha256").alias("ends_sha256"))
                .join(F.broadcast(split), "key", "left")      # at most one row per edge of two parts
                .withColumn("ends_sha256", F.coalesce("split_sha256", "ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
                .drop("split_sha256"))
    parents = (nodes.where("n_children > 0")
               .select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight")))
    return weighted_lookup(nodes, parents, ["parent"], "weight", "left")
