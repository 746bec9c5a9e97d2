"""The prefix trie of conversations: ternary search trees per range shard, merged at the shard boundaries.

A turn's id is the first 128 bits of the SHA-256 of its role and text, as two longs; a conversation is its path, the array of its
turns' ids. Paths are dealt to shards by their order (ties by conversation id, so even equal paths spread over shards). A shard
encodes its ids by a dictionary of its own and inserts its distinct paths into a ternary search tree, the middle one first, then the middles of
both halves, so that siblings form balanced trees. A child is made after its parent, hence one loop over the nodes from
last to first adds members, leaves and savings up the trie, without recursion.

Paths are in order, so only a prefix of a shard's first or last path can occur in another shard. All other nodes are complete.
These boundary nodes leave the shard as partial sums, in two chains (the prefixes of the first path and of the last), and are merged: sums by node,
then, since a merged node counts once in each of its ancestors, suffix sums along the chain that owns it. All of this is linear in the length of the chains.

A conversation is one row, and a shard holds ``shard_turns`` turns or one longer conversation. Ids of conversations that end in
a boundary node come as ordered chunks and pass through one running SHA-256; only the hash's state is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.text import arrow_batches
from callmeter.runtime import written

SHARD_TURNS = 1 << 16
#: Conversations of a group of this many consecutive ids begin alike; at most HEADS - 1 turns are taken over.
GROUP, HEADS = 5, 9
#: Conversation ids in one chunk of a boundary node's list.
CHUNK_IDS = 4096

INNER, CHAIN, ENDS = 0, 1, 2
_ROW = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("side", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("size", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()),
])
_SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
ROW = ", ".join(f"{f.name} {_SQL_TYPES[f.type]}" for f in _ROW)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """The first 32 hex digits of the digest of a turn; the role's length keeps role and text apart."""
    return F.substring(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256), 1, 32)


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path, sizes``: each conversation as it is, its turns in order (null first; equal turns by digest)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).alias("size")).alias("t"),
    )
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def half(turn: Column, first: int) -> Column:
        return F.conv(F.substring(turn["digest"], first, 16), 16, -10).cast("long")

    ids = F.flatten(F.transform("t", lambda x: F.array(half(x, 1), half(x, 17))))
    return lists.select("conv_id", ids.alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def with_shared_heads(own: DataFrame) -> DataFrame:
    """Paths rebuilt: the first h turns of conversation ``c - c % 5``, then the own turns after the first h, h = crc32(c) % 9."""
    heads = own.select(F.col("conv_id").alias("base"), F.slice("path", 1, 2 * (HEADS - 1)).alias("head"), F.slice("sizes", 1, HEADS - 1).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    asked = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h})

    def rebuilt(head: str, rest: str, per_turn: int) -> Column:
        taken = F.coalesce(F.slice(head, F.lit(1), F.col("h") * per_turn), F.slice(rest, F.lit(1), F.lit(0)))
        return F.concat(taken, F.slice(rest, F.col("h") * per_turn + 1, F.greatest(F.size(rest), F.lit(1))))

    return asked.join(heads, "base", "left").select("conv_id", rebuilt("head", "path", 2).alias("path"), rebuilt("head_sizes", "sizes", 1).alias("sizes"))


class Tree:
    """A ternary search tree over dictionary codes. Node 0 is the root; ``first`` leads to the middle child of a node, ``low`` and ``high`` to its siblings."""

    def __init__(self):
        self.code, self.first, self.low, self.high, self.up = [-1], [-1], [-1], [-1], [-1]
        self.depth, self.size, self.n, self.least, self.ends = [0], [0], [0], [1 << 63], [-1]

    def _new(self, code: int, parent: int, size: int) -> int:
        for column, value in ((self.code, code), (self.first, -1), (self.low, -1), (self.high, -1), (self.up, parent), (self.depth, self.depth[parent] + 1), (self.size, size), (self.n, 0), (self.least, 1 << 63), (self.ends, -1)):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], sizes: list[int], members: int, least: int, sequence: int) -> None:
        code_of, first, low, high, n, lowest = self.code, self.first, self.low, self.high, self.n, self.least
        at = 0
        n[0] += members
        lowest[0] = min(lowest[0], least)
        for code, size in zip(codes, sizes, strict=True):
            i = first[at]
            if i < 0:
                i = first[at] = self._new(code, at, size)
            while code_of[i] != code:
                side = low if code < code_of[i] else high
                if side[i] < 0:
                    side[i] = self._new(code, at, size)
                i = side[i]
            n[i] += members
            if least < lowest[i]:
                lowest[i] = least
            at = i
        self.ends[at] = sequence

    def walk(self, codes: list[int]) -> list[int]:
        """The nodes on a path that is in the tree, root first."""
        out = [0]
        for code in codes:
            i = self.first[out[-1]]
            while self.code[i] != code:
                i = self.low[i] if code < self.code[i] else self.high[i]
            out.append(i)
        return out


def _encoded(ids: np.ndarray) -> np.ndarray:
    """Dense codes of (long, long) pairs, in the order of the pairs."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ordered = ids[order]
    new = np.concatenate([[0], (ordered[1:] != ordered[:-1]).any(axis=1).astype(np.int64)]) if len(ids) else np.zeros(0, np.int64)
    codes = np.empty(len(ids), np.int64)
    codes[order] = np.cumsum(new)
    return codes


def _keys(path: np.ndarray) -> list[bytes]:
    """A key for every prefix of a path, the empty one first."""
    running = hashlib.blake2b(digest_size=16)
    out = [running.digest()]
    for pair in path:
        running.update(pair.tobytes())
        out.append(running.copy().digest())
    return out


def _nodes(shard: int, conv: np.ndarray, offsets: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[dict]:
    """All rows of one shard; ``offsets`` are in turns."""
    codes, turn_sizes = _encoded(ids).tolist(), sizes.tolist()
    bounds = offsets.tolist()
    same = [r > 0 and codes[bounds[r] : bounds[r + 1]] == codes[bounds[r - 1] : bounds[r]] for r in range(len(conv))]
    begins = [r for r, copy in enumerate(same) if not copy] + [len(conv)]
    members = conv.tolist()

    def path(q: int) -> list[int]:
        return codes[bounds[begins[q]] : bounds[begins[q] + 1]]

    tree, ranges = Tree(), [(0, len(begins) - 1)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            q = (a + b) // 2
            r = begins[q]
            tree.insert(path(q), turn_sizes[bounds[r] : bounds[r + 1]], begins[q + 1] - r, members[r], q)
            ranges += [(a, q), (q + 1, b)]

    chains = [tree.walk(path(0)), tree.walk(path(len(begins) - 2))]
    side_of = {i: side for side in (1, 0) for i in chains[side]}
    children, leaves, saved = [0] * len(tree.code), [0] * len(tree.code), [0] * len(tree.code)
    for i in range(len(tree.code) - 1, 0, -1):
        if i not in side_of:
            children[tree.up[i]] += 1
            leaves[i] += tree.first[i] < 0
            saved[i] += (tree.n[i] - 1) * tree.size[i]
        leaves[tree.up[i]] += leaves[i]
        saved[tree.up[i]] += saved[i]

    empty = hashlib.sha256(b"").hexdigest()
    for i in range(len(tree.code)):
        if i not in side_of:
            q, p = tree.ends[i], tree.up[i]
            ended = hashlib.sha256(",".join(map(str, members[begins[q] : begins[q + 1]])).encode()).hexdigest() if q >= 0 else empty
            yield {
                "kind": INNER, "shard": shard, "side": side_of.get(p), "conv_id": tree.least[i], "depth": tree.depth[i], "parent_conv_id": None if p in side_of else tree.least[p],
                "n_convs": tree.n[i], "n_children": children[i], "n_leaves": leaves[i], "saved_tokens": saved[i], "ends": ended,
            }
    for side, q in ((0, 0), (1, len(begins) - 2)):
        keys = _keys(ids[bounds[begins[q]] : bounds[begins[q] + 1]])
        for depth, i in enumerate(chains[side]):
            mine = side_of[i] == side  # a node on both chains is counted on the first
            yield {
                "kind": CHAIN, "shard": shard, "side": side, "key": keys[depth], "parent_key": keys[depth - 1] if depth else None, "depth": depth, "size": tree.size[i], "conv_id": tree.least[i],
                "n_convs": tree.n[i] * mine, "n_children": children[i] * mine, "n_leaves": leaves[i] * mine, "saved_tokens": saved[i] * mine,
            }
            if mine and tree.ends[i] >= 0:
                ended = members[begins[tree.ends[i]] : begins[tree.ends[i] + 1]]
                for c in range(0, len(ended), CHUNK_IDS):
                    yield {"kind": ENDS, "key": keys[depth], "conv_id": ended[c], "ends": ",".join(map(str, ended[c : c + CHUNK_IDS]))}


def _batches(rows: Iterator[dict], most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=_ROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ROW)


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, lengths, ids, sizes = [], [], [], []
    for batch in batches:
        path = batch.column(1)
        conv.append(batch.column(0).to_numpy())
        lengths.append(np.diff(path.offsets.to_numpy()) // 2)
        ids.append(path.flatten().to_numpy())
        sizes.append(batch.column(2).flatten().to_numpy())
    if conv:
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        yield from _batches(_nodes(TaskContext.get().partitionId(), np.concatenate(conv), offsets, np.concatenate(ids).reshape(-1, 2), np.concatenate(sizes)))


def _running_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per key over chunks that come in order."""
    key, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [running.hexdigest()]})

    for batch in batches:
        for k, chunk in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k != key:
                if running:
                    yield done()
                key, running = k, hashlib.sha256(chunk.encode())
            else:
                running.update(b"," + chunk.encode())
    if running:
        yield done()


def _boundary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged boundary nodes, and ``shard, side, depth, conv_id`` of every place on a chain."""
    chain = rows.where(F.col("kind") == CHAIN)
    merged = chain.groupBy("key", "parent_key", "depth", "size").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min(F.struct("shard", "side")).alias("owner"),
    )
    merged = written(merged, "boundary")
    below = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    nodes = merged.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more").join(above, "parent_key", "left")
    nodes = written(nodes, "boundary")

    # A merged node's own leaf and saving count on the chain that owns it, from there up to the root.
    mine = F.col("owner.shard").eqNullSafe(F.col("shard")) & F.col("owner.side").eqNullSafe(F.col("side"))
    own = nodes.select("key", F.col("conv_id").alias("least"), "owner", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saving"))
    placed = written(chain.select("shard", "side", "depth", "key").join(own, "key").select("shard", "side", "depth", "key", "least", F.when(mine, F.col("leaf")).otherwise(0).alias("leaf"), F.when(mine, F.col("saving")).otherwise(0).alias("saving")), "boundary")
    deeper = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.select("key", F.sum("leaf").over(deeper).alias("leaf"), F.sum("saving").over(deeper).alias("saving")).groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    hashes = rows.where(F.col("kind") == ENDS).select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_running_hash, "key binary, ends_sha256 string")
    whole = nodes.join(sums, "key").join(hashes, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return whole, placed.select("shard", "side", F.col("depth").alias("parent_depth"), F.col("least").alias("parent_least"))


def trie_nodes(own: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over ``conv_id, path, sizes``: a node is a distinct sequence of first turns."""
    spark = own.sparkSession
    arrow_batches(spark)
    own = written(own, "paths")
    turns = own.agg(F.sum(F.size("sizes"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-turns // shard_turns))
    rows = written(own.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_shard, ROW), "nodes")
    whole, places = _boundary(rows)
    inner = rows.where(F.col("kind") == INNER).withColumn("ends_sha256", F.col("ends"))
    settled = inner.where("parent_conv_id is not null").select(*COLUMNS)
    # Joined within the shard, so a boundary node with very many children meets them shard by shard.
    hanging = inner.where("parent_conv_id is null").withColumn("parent_depth", F.col("depth") - 1).join(places, ["shard", "side", "parent_depth"])
    return settled.union(hanging.withColumn("parent_conv_id", F.col("parent_least")).select(*COLUMNS)).union(whole.select(*COLUMNS))


def shared_prefixes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations (see ``with_shared_heads``), one row per node.

    ``conv_id`` (smallest member) and ``depth`` name a node; ``parent_conv_id`` is null at the root. A null role or text is empty, a null turn comes first, turns
    of one number are ordered by digest. Rows without a conversation id belong to no conversation and are left out. Repeated rows are turns of their own. A conversation without turns ends
    at the root. Other columns stay out; an empty table has no root and gives no rows.
    """
    return trie_nodes(with_shared_heads(paths(conversations)), shard_turns)
