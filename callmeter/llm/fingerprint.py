"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, at first its code points. On every level runs of equal names fold into one,
deterministic coin tossing gives each name a label below six that depends on a few names to its left only
(the lowest bit in which it differs from its neighbour, over and over), and local maxima of the labels begin phrases. A
phrase's hash is its name on the next level. Equal substrings get equal names away from their ends, wherever
they stand. A fingerprint is a MinHash over the names of the upper levels; likeness is the share of equal places.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmeter.llm.text import arrow_batches, id_and_text, mix
from callmeter.runtime import written

LEVELS = range(3, 7)  # the levels whose names count: phrases of about 20 characters and more
PLACES = 32
PIECE_CHARS = 1 << 20
_ONE = np.uint64(1)
_SALTS = mix(np.arange(1, PLACES + 1, dtype=np.uint64))


def _runs(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal neighbours become one name each; others stay as they are."""
    begins = np.ones(len(names), bool)
    begins[1:] = (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])
    if begins.all():
        return names, rows
    at = np.flatnonzero(begins)
    length = np.diff(np.append(at, len(names))).astype(np.uint64)
    own = names[at]
    return np.where(length > _ONE, mix(own + length * np.uint64(0xD6E8FEB86659FD93)), own), rows[at]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing until labels are below six; equal neighbours do not occur within a row."""
    label = names
    for _ in range(4):  # 64 bits: below 128, 14, 8, then 6
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = ~label[first]  # a row's first name differs from nothing in bit 0
        differ = label ^ left
        bit = np.bitwise_count((differ & (~differ + _ONE)) - _ONE).astype(np.uint64)
        label = bit * np.uint64(2) + ((label >> np.minimum(bit, np.uint64(63))) & _ONE)
    return label


def _next_level(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, rows = _runs(names, rows)
    new_row = np.ones(len(names), bool)
    new_row[1:] = rows[1:] != rows[:-1]
    label = _labels(names, np.flatnonzero(new_row))
    begins = new_row.copy()
    begins[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~new_row[2:]
    at = np.flatnonzero(begins)
    inside = (np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))).astype(np.uint64)
    return mix(np.add.reduceat(mix(names + inside * np.uint64(0x9E3779B97F4A7C15)), at)), rows[at]


def fingerprints(texts: list[str], places: int = PLACES) -> np.ndarray:
    """One row of ``places`` 32-bit numbers per text; an empty text has all ones."""
    out = np.full((len(texts), places), 0xFFFFFFFF, np.uint32)
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= PIECE_CHARS):
            chars += len(texts[j])
            j += 1
        out[i:j] = _sketch(texts[i:j], places)
        i = j
    return out


def _sketch(texts: list[str], places: int) -> np.ndarray:
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = np.full((len(texts), places), 0xFFFFFFFF, np.uint32)
    last = np.zeros(len(texts), np.int64)  # names a text has on the level before
    for level in range(1, LEVELS.stop):
        if not len(names):
            break
        names, rows = _next_level(names, rows)
        counts = np.bincount(rows, minlength=len(texts))
        # A short text counts from the level on which one name stands for all of it.
        use = level >= LEVELS.start
        chosen = np.ones(len(rows), bool) if use else counts[rows] == 1
        if chosen.any():
            own, own_rows = names[chosen], rows[chosen]
            at = np.flatnonzero(np.concatenate([[True], own_rows[1:] != own_rows[:-1]]))
            for p in range(places):
                value = (mix(own ^ _SALTS[p]) >> np.uint64(32)).astype(np.uint32)
                least = np.minimum.reduceat(value, at)
                out[own_rows[at], p] = np.minimum(out[own_rows[at], p], least)
        # A text that is one name needs no further level.
        last = counts
        more = last[rows] > 1
        names, rows = names[more], rows[more]
    return out


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


_PARTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part long, place string, text string"


def _rows(ids: list, texts: list[str], followers: list[str]) -> tuple[list, ...]:
    edited = [_edited(a, b) for a, b in zip(texts, followers, strict=True)]
    own, changed, after = fingerprints(texts), fingerprints(edited), fingerprints(followers[-1:])
    following = np.concatenate([own[1:], after])
    return (
        ids, [len(t) for t in texts], [sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        [r.astype(">u4").tobytes() for r in own], [r.astype(">u4").tobytes() for r in changed],
        (own == changed).mean(axis=1).tolist(), (own == following).mean(axis=1).tolist(),
    )


def _batch(columns: tuple[list, ...], part: int, places: list, texts: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
    values = [*columns, [part] * len(places), places, texts]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; the first text of a partition is handed on, the last one waits for the next partition's first."""
    held, part, begun = None, 0, False
    nothing = lambda n: tuple([None] * n for _ in range(6))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts, parts = (batch.column(i).to_pylist() for i in range(3))
        part = parts[0]
        if not begun:
            begun = True
            yield _batch(([ids[0]], *nothing(1)), part, ["first"], [texts[0]])
        if held:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids.pop(), texts.pop()
        for i in range(0, len(ids), 256):
            some = texts[i : i + 256]
            yield _batch(_rows(ids[i : i + 256], some, [*texts[i + 1 : i + 257], held[1]][: len(some)]), part, [None] * len(some), [None] * len(some))
    if held:
        yield _batch(([held[0]], *nothing(1)), part, ["last"], [held[1]])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        for doc_id, text, following in zip(rows["doc_id"], rows["text"], rows["following"], strict=True):
            yield _batch(_rows([doc_id], [text], [following]), 0, [None], [None])


def _hex(column: str) -> Column:
    return F.lower(F.hex(column))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the next document's first characters.

    Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The next row is that in
    order of id (null ids first, repeated ids by text); the last row's is the first. A null text counts as empty; an only row follows
    itself; an empty table gives no rows. Texts move once, into ranges of ids; a partition's last row meets the first of the next
    one in a second step over two rows per partition.
    """
    arrow_batches(docs.sparkSession)
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    parts = written(ranged.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_along, _PARTS), "fingerprints")
    edges = parts.where("place is not null")
    firsts = edges.where("place = 'first'").select("part", "text")
    known = sorted(r.part for r in firsts.select("part").collect())  # one number per partition
    after = dict(zip(known, known[1:] + known[:1], strict=True))
    following = docs.sparkSession.createDataFrame([(a, b) for a, b in after.items()], "part long, next_part long")
    lasts = edges.where("place = 'last'").select("part", "doc_id", "text").join(following, "part")
    met = lasts.join(firsts.select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part").select("doc_id", "text", "following")
    whole = parts.where("place is null").union(met.mapInArrow(_finish, _PARTS))
    return whole.select("doc_id", "n_chars", "edited_sha256", _hex("fingerprint").alias("fingerprint"), _hex("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
