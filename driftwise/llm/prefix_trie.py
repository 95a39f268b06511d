"""The trie of conversation prefixes, built over sorted shards and a skeleton of splitters.

A conversation is the string of its turns' 16-byte fingerprints (role and text). Some
splitters, taken from a sample of conversations, cut all of them in (path, conv_id) order
into shards. A node whose conversations lie in several shards lies on the path of a
splitter, since the splitter stands between them. So the trie of the splitters' paths, the
skeleton, goes to all tasks; each sorted shard builds every other node in one pass with a
stack and finishes it there, and hands on what it found of skeleton nodes: sums over
conversations that end at one and over its subtrees outside the skeleton. These sums are
added per node and then up the skeleton. Copies of one conversation are cut between their
ids, so no key is ever in one shard.

The skeleton's nodes are at most ``SKELETON``: with longer conversations there are fewer
splitters. Which conversations are sampled only decides how even the shards are.

Cases: a null role or text is an empty one; turns are in order of turn (null first), then
role, then fingerprint, so repeated rows are turns of their own; a row without conv_id
belongs to no conversation; the base of c is c - c % 20 with the sign of c, as in SQL; an
empty table has no node, not even the root; other columns are not read. One conversation's
fingerprints (16 bytes a turn) are held as one value.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftwise.llm.common import saved, tasks

BYTES = 16
#: Nodes of the skeleton at most.
SKELETON = 1 << 17
#: Conversations sampled for each shard.
SAMPLED = 20
#: Ids of conversations that end at a skeleton node are handed on in strings of about so many characters.
CHUNK = 1 << 16
BATCH = 1 << 13
BASE, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256().hexdigest()

ROW = {"skeleton": "int", "above": "int", "conv_id": "long", "depth": "int", "parent_conv_id": "long", "n_convs": "long",
       "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string",
       "shard": "int", "number": "int", "ends": "string"}
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in ROW.items())
ARROW = pa.schema([(name, KINDS[kind]) for name, kind in ROW.items()])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, each with its fingerprint and number of words."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    each = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        role.alias("role"), F.md5(F.concat(F.length(role), F.lit(":"), role, text)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return each.filter("conv_id is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "key", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation with its first turns taken from its base."""
    own = saved(turns(conversations), "turns")
    heads = own.filter(F.col("conv_id") % BASE == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    based = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BASE, "h": taken}).join(heads, "base", "left")

    def after(rows: Column) -> Column:
        return F.slice(rows, F.col("h") + 1, F.greatest(F.size(rows) - F.col("h"), F.lit(0)))

    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return based.select("conv_id", F.concat(first, after(F.col("turns"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words): fingerprints of a conversation's turns in one string of bytes, and their words."""
    return conversations.select(
        "conv_id", F.unhex(F.array_join("turns.key", "")).alias("path"), F.col("turns.words").alias("words"))


class Skeleton:
    """The trie of some paths; node 0 is the root and a node's number is above its parent's."""

    def __init__(self, splitters: list):
        self.splitters = [(bytes(r.path), r.conv_id) for r in splitters]
        self.next: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.words = [-1], [0], [0]
        for row in splitters:
            node, path = 0, bytes(row.path)
            for at, words in enumerate(row.words):
                step = (node, path[at * BYTES:(at + 1) * BYTES])
                if step not in self.next:
                    self.next[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(at + 1)
                    self.words.append(words)
                node = self.next[step]

    def deepest(self, path: bytes) -> int:
        node = 0
        for at in range(0, len(path), BYTES):
            further = self.next.get((node, path[at:at + BYTES]))
            if further is None:
                break
            node = further
        return node


def skeleton(frame: DataFrame, shards: int) -> Skeleton:
    """Splitters of about equal shards, from the conversations of the smallest hashes of ids."""
    longest = (frame.agg(F.max(F.length("path"))).first()[0] or 0) // BYTES
    shards = max(1, min(shards, SKELETON // max(1, longest)))
    sample = frame.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLED)
    placed = sample.withColumn("at", F.row_number().over(W.orderBy("path", "conv_id")))
    return Skeleton(placed.filter(F.col("at") % SAMPLED == 0).drop("at").orderBy("path", "conv_id").limit(shards - 1).collect())


def _dealt(tree: Skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            yield batch.append_column("shard", pa.array([bisect_right(tree.splitters, r) for r in rows], pa.int32()))

    return run


class _Node:
    __slots__ = ("depth", "words", "least", "convs", "children", "leaves", "saved", "ends", "below")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.least, self.ends, self.below = depth, words, None, None, []
        self.convs = self.children = self.leaves = self.saved = 0

    def add(self, least: int, convs: int, leaves: int, saved: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.convs += convs
        self.leaves += leaves
        self.saved += saved


def _shard(tree: Skeleton):
    """Over rows in order of (shard, path, conv_id): the finished nodes, and what a shard knows of skeleton nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        stack: list[_Node] = []
        partial: dict[int, _Node] = {}
        before, top, place, ending, ids, size, number = b"", 0, None, None, [], 0, 0

        def of_skeleton(node: int) -> _Node:
            return partial.setdefault(node, _Node(tree.depth[node], tree.words[node]))

        def close() -> None:
            node = stack.pop()
            node.leaves += not node.children
            node.saved += (node.convs - 1) * node.words
            for row in node.below:
                row["parent_conv_id"] = node.least
            out.extend(node.below)
            row = {"conv_id": node.least, "depth": node.depth, "n_convs": node.convs, "n_children": node.children,
                   "n_leaves": node.leaves, "saved_tokens": node.saved,
                   "ends_sha256": node.ends.hexdigest() if node.ends else NO_ENDS}
            above = stack[-1] if stack else of_skeleton(top)
            above.add(node.least, node.convs, node.leaves, node.saved)
            above.children += 1
            if stack:
                above.below.append(row)
            else:
                out.append(row | {"above": top})

        def hand_on() -> None:
            nonlocal ids, size, number
            if ids:
                out.append({"skeleton": ending, "shard": place, "number": number, "ends": ",".join(ids)})
                ids, size, number = [], 0, number + 1

        def partials() -> None:
            out.extend({"skeleton": k, "conv_id": n.least, "n_convs": n.convs, "n_children": n.children,
                        "n_leaves": n.leaves, "saved_tokens": n.saved} for k, n in partial.items())
            partial.clear()

        def taken() -> pa.RecordBatch:
            nonlocal out
            rows, out = out, []
            return pa.RecordBatch.from_pylist(rows, ARROW)

        for batch in batches:
            for shard, path, conv, words in zip(*[batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words")], strict=True):
                shared, limit = 0, min(len(path), len(before))
                while shared < limit and path[shared:shared + BYTES] == before[shared:shared + BYTES]:
                    shared += BYTES
                while stack and (shard != place or stack[-1].depth * BYTES > shared):
                    close()
                if shard != place:
                    hand_on()
                    partials()
                    place, number = shard, 0
                if path != before or ending is None:
                    hand_on()
                before = path
                if not stack:
                    top = tree.deepest(path)
                for depth in range((stack[-1].depth if stack else tree.depth[top]) + 1, len(words) + 1):
                    stack.append(_Node(depth, words[depth - 1]))
                if stack:
                    last = stack[-1]
                    first = last.ends is None
                    last.ends = last.ends or hashlib.sha256()
                    last.ends.update(str(conv).encode() if first else f",{conv}".encode())
                    last.add(conv, 1, 0, 0)
                else:
                    ending = top
                    of_skeleton(top).add(conv, 1, 0, 0)
                    ids.append(str(conv))
                    size += len(ids[-1]) + 1
                    if size > CHUNK:
                        hand_on()
                if len(out) > BATCH:
                    yield taken()
        while stack:
            close()
        hand_on()
        partials()
        if out:
            yield taken()

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, ends_sha256) from the strings of ids in order of (skeleton, shard, number)."""
    at, digest = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"skeleton": pa.array([at], pa.int32()), "ends_sha256": pa.array([digest.hexdigest()])})

    for batch in batches:
        for node, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ends"), strict=True):
            if node != at:
                if digest:
                    yield told()
                at, digest = node, hashlib.sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
    if digest:
        yield told()


def _reduced(tree: Skeleton):
    """The skeleton's nodes from one row of sums for each, added up from the deepest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [_Node(d, w) for d, w in zip(tree.depth, tree.words, strict=True)]
        any_row = False
        for batch in batches:
            for row in batch.to_pylist():
                any_row = True
                nodes[row["skeleton"]].add(row["conv_id"], row["n_convs"], row["n_leaves"], row["saved_tokens"])
                nodes[row["skeleton"]].children += row["n_children"]
        if not any_row:
            return
        for k in range(len(nodes) - 1, -1, -1):
            node = nodes[k]
            node.leaves += not node.children
            node.saved += (node.convs - 1) * node.words if k else 0
            if k:
                above = nodes[tree.parent[k]]
                above.add(node.least, node.convs, node.leaves, node.saved)
                above.children += 1
        for at in range(0, len(nodes), BATCH):
            yield pa.RecordBatch.from_pylist([
                {"skeleton": k, "conv_id": n.least, "depth": n.depth, "n_convs": n.convs, "n_children": n.children,
                 "parent_conv_id": nodes[tree.parent[k]].least if k else None,
                 "n_leaves": n.leaves, "saved_tokens": n.saved} for k, n in enumerate(nodes[at:at + BATCH], at)], ARROW)

    return run


def trie(frame: DataFrame, shards: int) -> DataFrame:
    """One row per node over (conv_id, path, words); conv_ids are distinct."""
    spark: SparkSession = frame.sparkSession
    tree = skeleton(frame, shards)
    dealt = frame.mapInArrow(_dealt(tree), "conv_id long, path binary, words array<long>, shard int")
    ordered = dealt.repartitionById(len(tree.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    found = saved(ordered.mapInArrow(_shard(tree), SCHEMA), "nodes")
    ends = found.filter("ends is not null").repartition(tasks(spark), "skeleton").sortWithinPartitions(
        "skeleton", "shard", "number").select("skeleton", "ends").mapInArrow(_hashed, "skeleton int, ends_sha256 string")
    sums = found.filter("skeleton is not null and ends is null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    whole = saved(sums.repartition(1).mapInArrow(_reduced(tree), SCHEMA).drop("ends_sha256").join(
        ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "skeleton")
    below = found.filter("skeleton is null")
    # At most SKELETON rows of two numbers.
    least = F.broadcast(whole.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("least")))
    named = below.join(least, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least"))
    return named.select(*NODE).unionByName(whole.select(*NODE)).withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    frame = saved(paths(rebuilt(conversations)), "paths")
    return trie(frame, tasks(conversations.sparkSession))
