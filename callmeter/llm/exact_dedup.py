"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

A normalised text is found by a 64-bit key. Equal texts are folded first: the aggregate that does so compares bytes and combines
in each task before anything moves, so a text that a third of all rows share is one row per task. What is left are links: one per
distinct text, with the id that stays and the number of copies. A directory cuts the key space into buckets:
it starts so deep that buckets are half full on average, and doubles (one more key bit for the bucket that overflows) until every
bucket holds at most ``capacity`` keys. Owner tasks take whole buckets, in ranges of the key, chain the links that share a key,
and write them in key order, so a later search reads the row groups of its own keys.

A search joins on key and digest; inside a chain all links have been told apart by their bytes. Texts with more than a
``HOT_CHAINS``-th part of all rows are at most that many and are broadcast, so no search task meets a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.text import sha256_hex
from callmeter.runtime import written

#: Keys a bucket holds before it splits.
CAPACITY = 1 << 20
#: A directory up to this size (16 bytes a slot) is broadcast; a larger one is joined by shuffle.
BROADCAST_SLOTS = 1 << 17
#: At most so many texts can each be more than this part of all rows.
HOT_CHAINS = 4096
KEY_BITS = 64


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case and nothing else. Texts of ASCII only take the quicker function."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def leading_bits(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key, the others 0."""
    return F.shiftleft(F.shiftrightunsigned(key, 64 - depth), 64 - depth) if depth else F.lit(0).cast("long")


@dataclass(frozen=True)
class ExactIndex:
    """``links(bucket, key, link, chained, keep_id, group_size, text_sha256)`` and ``directory(slot, bucket, depth)``.

    ``depth`` is the directory's own depth: a slot is a key's first ``depth`` bits.
    """

    links: DataFrame
    directory: DataFrame
    depth: int
    rows: int
    key_bits: int = KEY_BITS

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``doc_id, keep_id, group_size, text_sha256`` for every row of ``docs``; the two in the middle are null for a text the index does not hold."""
        asked = written(_keyed(docs, id_col, text_col, self.key_bits).select("doc_id", "key", sha256_hex(F.col("norm")).alias("text_sha256")), "asked")
        wanted = ["key", "text_sha256"]
        stored = self.links.select(*wanted, "keep_id", "group_size")
        is_hot = F.col("group_size") * HOT_CHAINS > self.rows
        hot, rest = F.broadcast(stored.where(is_hot)), stored.where(~is_hot)
        columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
        return asked.join(hot, wanted).select(*columns).union(asked.join(hot, wanted, "left_anti").join(rest, wanted, "left").select(*columns))


def _keyed(docs: DataFrame, id_col: str, text_col: str, key_bits: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return texts.withColumn("key", leading_bits(F.xxhash64("norm"), key_bits))


def _doubled(keys: DataFrame, n: int, capacity: int) -> tuple[DataFrame, int]:
    """The buckets of a directory, ``(bucket, depth, held)``, and its depth. All buckets that overflow in a round have the directory's depth."""
    depth = min(64, max(0, (2 * n // capacity).bit_length() - 1))
    buckets = written(keys.groupBy(leading_bits(F.col("key"), depth).alias("bucket")).agg(F.count("*").alias("held")).withColumn("depth", F.lit(depth)), "directory")
    while depth < 64:
        full = buckets.where((F.col("held") > capacity) & (F.col("depth") == depth))
        if full.isEmpty():
            break
        inside = keys.withColumn("bucket", leading_bits(F.col("key"), depth)).join(full.select("bucket"), "bucket", "left_semi")
        depth += 1
        halves = inside.groupBy(leading_bits(F.col("key"), depth).alias("bucket")).agg(F.count("*").alias("held")).withColumn("depth", F.lit(depth))
        buckets = written(buckets.join(full.select("bucket", "depth"), ["bucket", "depth"], "left_anti").unionByName(halves), "directory")
    return buckets, depth


def _slots(buckets: DataFrame, depth: int) -> DataFrame:
    """Every slot of the directory with its bucket: a bucket that split less often has several."""
    if not depth:
        return buckets.select(F.col("bucket").alias("slot"), "bucket", "depth")
    among = F.explode(F.expr(f"sequence(0L, shiftleft(1L, {depth} - depth) - 1)")).alias("i")
    step = F.shiftleft(F.lit(1).cast("long"), 64 - depth)
    return buckets.select("bucket", "depth", among).select((F.col("bucket") + F.col("i") * step).alias("slot"), "bucket", "depth")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> ExactIndex:
    """Index every text of ``docs``. Fewer ``key_bits`` only make chains longer."""
    keyed = _keyed(docs, id_col, text_col, key_bits)
    folded = keyed.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    links = written(folded.select("key", "keep_id", "group_size", sha256_hex(F.col("norm")).alias("text_sha256")), "links")
    keys = links.select("key").distinct() if key_bits < KEY_BITS else links.select("key")
    n_links, rows = links.agg(F.count("*"), F.sum("group_size")).first()
    buckets, depth = _doubled(keys, n_links, capacity)
    directory = written(_slots(buckets, depth), "directory")
    if depth:
        slots = directory.select("slot", "bucket")
        slots = F.broadcast(slots) if 1 << depth <= BROADCAST_SLOTS else slots
        placed = links.withColumn("slot", leading_bits(F.col("key"), depth)).join(slots, "slot").drop("slot")
    else:
        placed = links.withColumn("bucket", leading_bits(F.col("key"), 0))
    # One owner per bucket: chains are complete in it, and need no further exchange.
    chain = Window.partitionBy("bucket", "key")
    owned = placed.repartitionByRange("bucket").select(
        "bucket", "key", F.row_number().over(chain.orderBy("text_sha256")).alias("link"), F.count("*").over(chain).alias("chained"), "keep_id", "group_size", "text_sha256",
    )
    return ExactIndex(written(owned.sortWithinPartitions("bucket", "key"), "index"), directory, depth, rows or 0, key_bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The row with the largest id stays. A null id
    ranks below every other: such a row stays only where its text has no other id. Rows that repeat the staying id with the same text cannot be told
    apart and stay together; different texts under one id are judged apart. Other columns, whatever their names, stay out; an empty table gives no rows.
    """
    found = build(docs, id_col, text_col, capacity, key_bits).find(docs, id_col, text_col)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
