"""Cost-balanced packing of token ids into sequences of a fixed length.

Every document is tokenised whole and ends with one separator id. Per chunk of documents (a bounded
number of tokens of one input split; no shuffle) the sequences to fill are known: as many full ones as the tokens
allow, and for the rest one sequence for each power of two in it, so that nothing is padded. Pieces
(documents, cut where longer than a sequence) go in descending length to the sequence with the lowest
attention cost, ``linear * n + quadratic * n**2`` summed over its pieces, that has enough room; pieces that fit nowhere
are cut over the room that is left.
"""

from __future__ import annotations

import heapq
import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.llm.text import arrow_batches, id_and_text

LENGTH = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096  # a piece of 4096 tokens costs as much in attention as in the rest of the layer
CHUNK_TOKENS = 4 << 20
CACHE_WORDS = 1 << 20
# Word boundary pattern of the byte-level tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes, exactly as the tokenizer file defines them.

    The words of a text repeat, so ids are kept per space-delimited chunk, in a cache of bounded size. A
    chunk boundary before a single space is always a word boundary of the tokenizer; a text where
    white space meets white space, or that holds an added token's string, is encoded as a whole.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model = json.loads(whole.to_str())
        letters = {chr(c): b for b, c in zip(_visible_bytes(), _visible_points(), strict=True)}
        ranks = {bytes(letters[ch] for ch in token): i for token, i in model["model"]["vocab"].items()}
        self._plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = whole
        self._added = [t["content"] for t in model["added_tokens"]]
        self._odd = regex.compile(r"\s\s|^\s|\s$").search
        self._head: dict[str, bytes] = {}
        self._next: dict[str, bytes] = {}

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return array("I", ids if sys.byteorder == "little" else [int.from_bytes(i.to_bytes(4, "little"), "big") for i in ids]).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self._added):
            return self._raw(self._whole.encode(text, add_special_tokens=False).ids)
        if self._odd(text):
            return self._raw(self._plain.encode_ordinary(text))
        if len(self._next) > CACHE_WORDS:
            self._next.clear()
        if len(self._head) > 4096:
            self._head.clear()
        head, *rest = text.split(" ")
        if head not in self._head:
            self._head[head] = self._raw(self._plain.encode_ordinary(head))
        known = self._next
        try:
            return self._head[head] + b"".join(map(known.__getitem__, rest))
        except KeyError:
            for word in rest:
                if word not in known:
                    known[word] = self._raw(self._plain.encode_ordinary(" " + word))
            return self._head[head] + b"".join(map(known.__getitem__, rest))


def _visible_bytes() -> list[int]:
    """Bytes in the order in which byte-level vocabularies give them printable characters."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return printable + [b for b in range(256) if b not in set(printable)]


def _visible_points() -> list[int]:
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return printable + [256 + i for i in range(256 - len(printable))]


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Full sequences, then the powers of two that make up the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def place(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces ``(document, start, size, sequence, offset)`` and each sequence's cost; every sequence ends full."""
    room = capacities(sum(sizes), length)
    cost, used = [0.0] * len(room), [0] * len(room)
    out = []

    def put(doc: int, start: int, size: int, at: int) -> None:
        out.append((doc, start, size, at, used[at]))
        used[at] += size
        room[at] -= size
        cost[at] += linear * size + quadratic * size * size

    full = total_full = sum(sizes) // length
    parts = []
    for doc, size in enumerate(sizes):
        cut = size // length * length
        for start in range(0, cut, length):
            full -= 1
            put(doc, start, length, full)
        if size - cut:
            parts.append((size - cut, doc, cut))
    parts.sort(key=lambda p: (-p[0], p[1]))
    # Sequences still open, cheapest first; one whose room is below the piece waits for smaller pieces.
    heap = [(0.0, i) for i in range(len(room)) if room[i]]
    heapq.heapify(heap)
    waiting: list[tuple[int, float, int]] = []  # by room, largest first
    late = []
    for size, doc, start in parts:
        while waiting and -waiting[0][0] >= size:
            _, c, i = heapq.heappop(waiting)
            heapq.heappush(heap, (c, i))
        while heap and room[heap[0][1]] < size:
            c, i = heapq.heappop(heap)
            heapq.heappush(waiting, (-room[i], c, i))
        if not heap:
            late.append((doc, start, size))
            continue
        _, i = heapq.heappop(heap)
        put(doc, start, size, i)
        if room[i]:
            heapq.heappush(heap, (cost[i], i))
    free = sorted((i for i in range(len(room)) if room[i]), key=lambda i: -room[i])
    for doc, start, size in late:
        while size:
            part = min(size, room[free[-1]]) if room[free[0]] < size else size
            at = free[-1] if room[free[0]] < size else free[0]
            put(doc, start, part, at)
            start, size = start + part, size - part
            free = sorted((i for i in free if room[i]), key=lambda i: -room[i])
    assert not any(room) and total_full == sum(sizes) // length
    return out, cost


def _pack(tokenizer: str, length: int, end_id: int, chunk_tokens: int, linear: float, quadratic: float):
    def flush(chunk: list[tuple[int | None, bytes]], base: int) -> tuple[pa.RecordBatch, int]:
        sizes = [len(raw) // 4 for _, raw in chunk]
        placed, cost = place(sizes, length, linear, quadratic)
        doc, start, size, at, offset = (np.array(c, np.int64) for c in zip(*placed, strict=True))
        check = [zlib.crc32(memoryview(chunk[d][1])[4 * s : 4 * (s + n)]) for d, s, n, *_ in placed]
        ids = pa.array([chunk[d][0] for d in doc.tolist()], pa.int64())
        columns = [ids, pa.array(start), pa.array(size), pa.array(check, pa.int64()), pa.array(np.array(sizes)[doc]), pa.array(at + base), pa.array(offset), pa.array(np.array(cost)[at])]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")]), base + len(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer), Encoder._raw([end_id])
        chunk, tokens, base = [], 0, None
        for batch in batches:
            ids, texts, parts = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, text, part in zip(ids, texts, parts, strict=True):
                base = part << 33 if base is None else base
                raw = encode(text) + end
                chunk.append((doc_id, raw))
                tokens += len(raw) // 4
                if tokens >= chunk_tokens:
                    out, base = flush(chunk, base)
                    yield out
                    chunk, tokens = [], 0
        if chunk:
            yield flush(chunk, base)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost`` (of its sequence).

    A null text counts as empty and has the separator id alone. Repeated rows are packed as often as they
    occur, null ids are kept; an empty table gives no rows. ``length`` must be a power of two. A sequence lies in one input
    split, whose number is the upper part of ``sequence_id``; a task that runs again gives the same pieces.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    arrow_batches(docs.sparkSession)
    numbered = id_and_text(docs, id_col, text_col).withColumn("part", F.spark_partition_id().cast("long"))
    return numbered.mapInArrow(_pack(tokenizer, length, end_id, chunk_tokens, linear, quadratic), SCHEMA)


def sequences(spark: SparkSession, docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Per sequence: its tokens, number of pieces and attention cost."""
    return pack(docs, tokenizer, **options).groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"), F.first("cost").alias("cost"))
