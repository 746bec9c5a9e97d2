"""Which windows of a document also stand in a document with a smaller id: the part two operators share.

Every window of W tokens is led to its minimizer, the least hash of the K-grams in it. Consecutive windows with one minimizer form a
fragment; equal windows always have equal minimizers, whatever surrounds them. Fragments meet by
minimizer: a fragment that a smaller id has too is settled there (equal minimizer and content hash, 128 bits together); distinct
fragments with one minimizer go, with their tokens, to an index of bounded blocks, which the caller gives. A minimizer with
very many distinct fragments is met window by window instead, so no block holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.text import Powers, Words, _BYTE_CODE, arrow_batches, as_long, id_and_text, mix, pieces
from callmeter.runtime import written, written_for

PIECE = 2 << 20
BLOCK_TOKENS = 1 << 18
HOT_FRAGMENTS = 1000
_RUN_BITS = 24  # windows in a fragment; longer runs are cut
_U = np.uint64


@dataclass(frozen=True)
class Unit:
    """What a token is: bytes, or words hashed whole."""

    window: int
    gram: int
    words: bool

    def tokens(self, data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Token codes and where each row's begin."""
        if self.words:
            found = Words(data, offsets, powers)
            return found.hash, found.first
        return _BYTE_CODE[data], offsets


def _sliding(codes: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every ``width`` consecutive values, by doubling. ``join(left, right, distance)``."""
    have, out = 1, codes
    while have * 2 <= width:
        out = join(out[: len(out) - have], out[have:], have)
        have *= 2
    if have < width:
        out = join(out[: len(out) - (width - have)], out[width - have :], width - have)
    return out


def _polynomial(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` (a power of two) consecutive codes."""
    return mix(_sliding(codes, width, lambda a, b, n: a * _U(pow(0x9E3779B97F4A7C15, n, 2**64)) + b))


def fragments(codes: np.ndarray, first: np.ndarray, unit: Unit, powers: Powers) -> tuple[np.ndarray, ...]:
    """Fragments of all rows: minimizer, content hash, row, first window (within the row), number of windows."""
    none = np.zeros(0, np.uint64)
    if len(codes) < unit.window:
        return none, none, none.astype(np.int64), none.astype(np.int64), none.astype(np.int64)
    grams = _polynomial(codes, unit.gram)
    least = _sliding(grams, unit.window - unit.gram + 1, lambda a, b, n: np.minimum(a, b))
    inside = np.ones(len(least), bool)
    for last in first[1:-1]:  # windows over the end of a row
        inside[max(0, last - unit.window + 1) : last] = False
    change = np.ones(len(least) + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
    row_begin = first[:-1]
    change[row_begin[row_begin < len(least)]] = True
    at = np.flatnonzero(change)
    # Runs too long for a run's bits are cut at fixed lengths from their begin.
    most = (1 << _RUN_BITS) - 1
    cuts = -(-np.diff(at) // most)
    begin = np.repeat(at[:-1], cuts) + most * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    end = np.append(begin[1:], at[-1])
    good = inside[begin]
    begin, end = begin[good], end[good]
    up, down = powers.to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    stop = end + unit.window - 1
    content = mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    row = np.searchsorted(first, begin, side="right") - 1
    return least[begin], content, row, begin - first[row], end - begin


_FRAGMENT = "h long, f long, doc_id long, run long"


def _emit(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches, most=PIECE):
            codes, first = unit.tokens(data, offsets, powers)
            h, f, row, start, n = fragments(codes, first, unit, powers)
            ids = batch.column(0).to_numpy()[row]
            for i in range(0, len(h), 1 << 16):
                j = i + (1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array(x[i:j]) for x in (as_long(h), as_long(f), ids, (start << _RUN_BITS) | n)], names=["h", "f", "doc_id", "run"])

    return run


_SETTLED = "h long, f long, doc_id long, run long, repeated boolean"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, f, doc_id): marks fragments that a smaller id has, keeps firsts of minimizers with several fragments.

    State between batches is one group's head: its minimizer, content, first id, and the rows of that id not yet decided.
    """
    h0 = f0 = d0 = None
    several, pending = False, np.zeros((4, 0), np.int64)

    def out(rows: np.ndarray, repeated: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in rows), pa.array(repeated)], names=["h", "f", "doc_id", "run", "repeated"])

    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.stack([batch.column(i).to_numpy() for i in range(4)])
        rows = np.concatenate([pending, new], axis=1) if pending.shape[1] else new
        h, f, d = rows[0], rows[1], rows[2]
        head_h = np.ones(len(h), bool)
        head_h[1:] = h[1:] != h[:-1]
        head_f = head_h.copy()
        head_f[1:] |= f[1:] != f[:-1]
        if h0 is not None and h[0] == h0:
            head_h[0] = False
            head_f[0] = f[0] != f0
        group = np.cumsum(head_h)  # 0: goes on from before
        f_at = np.flatnonzero(head_f)
        part = np.searchsorted(f_at, np.arange(len(h)), side="right")  # 0: goes on from before
        least = np.concatenate([[d0 if d0 is not None else 0], d[f_at]])[part]
        repeated = d > least
        contents = np.bincount(group[f_at], minlength=group[-1] + 1)
        contents[0] += 1 if h0 is not None else 0
        multi = contents > 1
        multi[0] |= several
        last = group == group[-1]
        undecided = last & ~repeated & ~multi[group[-1]]
        look = ~repeated & multi[group]
        send = repeated | look
        h0, f0, d0, several = h[-1], f[-1], least[-1], bool(multi[group[-1]])
        pending = rows[:, undecided]
        if send.any():
            yield out(rows[:, send], repeated[send])


def _window_keys(codes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the ``width`` codes from each place in ``at``, all places in step."""
    one, two = (np.zeros(len(at), np.uint64) for _ in range(2))
    for j in range(width):
        code = codes[at + j]
        one += code * _U(pow(0x9E3779B97F4A7C15, j + 1, 2**64))
        two += mix(code + _U(j))
    return mix(one), mix(two)


_CONTENT = pa.schema([(n, pa.int64()) for n in ("h", "f", "doc_id", "run")] + [("tokens", pa.binary())])


def _contents(unit: Unit):
    """Tokens of the wanted fragments of a text; of hot minimizers, a hash pair for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches, most=PIECE):
            codes, first = unit.tokens(data, offsets, powers)
            source, row_at = (codes, first) if unit.words else (data, offsets)
            runs = batch.column(2)
            wanted = runs.flatten()
            if not len(wanted):
                continue
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
            place, h = (wanted.field(n).to_numpy() for n in ("run", "h"))
            hot = wanted.field("hot").to_numpy(zero_copy_only=False)
            doc, start, n = batch.column(0).to_numpy()[row], place >> _RUN_BITS, place & ((1 << _RUN_BITS) - 1)
            at = np.asarray(row_at, np.int64)[row] + start
            cold = np.flatnonzero(~hot)
            for i in range(0, len(cold), 1 << 14):
                part = cold[i : i + (1 << 14)]
                tokens = [source[a:b].tobytes() for a, b in zip(at[part].tolist(), (at[part] + n[part] + unit.window - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (h[part], np.zeros(len(part), np.int64), doc[part], place[part])), pa.array(tokens, pa.binary())], schema=_CONTENT)
            # Windows of all hot fragments are hashed together, a bounded number of them at a time; a long fragment may go over several turns.
            many, crowded = n[hot], np.flatnonzero(hot)
            ends = np.cumsum(many)
            for i in range(0, int(ends[-1]) if len(ends) else 0, 1 << 16):
                window = np.arange(i, min(i + (1 << 16), int(ends[-1])))
                which = np.searchsorted(ends, window, side="right")
                own, k = crowded[which], window - (ends[which] - many[which])
                one, two = _window_keys(codes, at[own] + k, unit.window)
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (as_long(one), as_long(two), doc[own], (start[own] + k) << _RUN_BITS | 1)), pa.nulls(len(own), pa.binary())], schema=_CONTENT)

    return run


def _in_blocks(repeats_in: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]], unit: Unit):
    """Whole minimizer groups, gathered to blocks of bounded size; each block is one index."""
    kind = np.uint64 if unit.words else np.uint8

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1])
        marks = repeats_in([np.frombuffer(r[3], kind) for r in rows], np.array([r[1] for r in rows], np.int64))
        # Runs of marked windows, of all fragments in one go: an unmarked place between two fragments keeps them apart.
        sizes = np.array([len(m) + 1 for m in marks])
        flat = np.zeros(int(sizes.sum()) + 1, np.int8)
        begins = np.cumsum(sizes) - sizes + 1
        for at, mark in zip(begins.tolist(), marks, strict=True):
            flat[at : at + len(mark)] = mark
        edge = np.flatnonzero(np.diff(flat)) + 1
        a, b = edge[::2], edge[1::2]
        own = np.searchsorted(begins, a, side="right") - 1
        doc = np.array([r[1] for r in rows], np.int64)[own]
        run = (((np.array([r[2] for r in rows], np.int64)[own] >> _RUN_BITS) + a - begins[own]) << _RUN_BITS) | (b - a)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(run, pa.int64())], names=["doc_id", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, width = [], 0, np.dtype(kind).itemsize
        for batch in batches:
            for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("h", "doc_id", "run", "tokens")), strict=True):
                if size >= BLOCK_TOKENS and r[0] != rows[-1][0]:
                    yield solved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3]) // width
        if rows:
            yield solved(rows)

    return run


def covered(docs: DataFrame, unit: Unit, repeats_in: Callable, render: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_FRAGMENTS) -> DataFrame:
    """``render(batch with doc_id, text, runs, copy)`` for every row: ``runs`` of window starts that repeat, ``copy`` if the whole text does.

    ``repeats_in(fragments, ids)``, fragments ascending by id, gives for every window of each whether a smaller id has it.
    """
    arrow_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    digest = F.sha2("text", 256)
    keyed = texts.where("doc_id is not null").select("doc_id", digest.alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = written(keyed.join(first, "digest").where("doc_id > low").select("doc_id").distinct(), "repeats")
    # Copies of a whole earlier text are settled already: only originals are cut into fragments.
    unlike = texts.where("doc_id is not null").join(copies, "doc_id", "left_anti")
    met = unlike.mapInArrow(_emit(unit), _FRAGMENT).repartition("h").sortWithinPartitions("h", "f", "doc_id").mapInArrow(_settle, _SETTLED)
    settled = written(met, "repeats")
    look = settled.where("not repeated")
    crowded = look.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h").withColumn("hot", F.lit(True))
    wanted = look.join(crowded, "h", "left").groupBy("doc_id").agg(F.collect_list(F.struct("run", "h", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    cut = unlike.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_contents(unit), "h long, f long, doc_id long, run long, tokens binary")
    # One after the other, and gone from the disks before the texts are shuffled again.
    with written_for(cut, "repeats") as contents:
        from_index = contents.where("tokens is not null").repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(_in_blocks(repeats_in, unit), "doc_id long, run long")
        one_by_one = contents.where("tokens is null").select("h", "f", "doc_id", "run").repartition("h", "f").sortWithinPartitions("h", "f", "doc_id").mapInArrow(_settle, _SETTLED).where("repeated")
        found = [written(part.select("doc_id", "run"), "repeats") for part in (from_index, one_by_one)]
    runs = settled.where("repeated").select("doc_id", "run").union(found[0]).union(found[1])
    gathered = runs.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    whole = texts.where("doc_id is not null").join(gathered, "doc_id", "left").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    nameless = texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("runs"), F.lit(None).cast("boolean").alias("copy"))
    ready = whole.select("doc_id", "text", "runs", "copy").union(nameless)
    return ready.select("doc_id", "text", F.coalesce("runs", F.array().cast("array<long>")).alias("runs"), F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(render, schema)


def removed(runs: list[int], copy: bool, tokens: int, window: int) -> np.ndarray:
    """Which tokens the repeated windows cover."""
    if copy:
        return np.full(tokens, tokens >= window)
    change = np.zeros(tokens + 1, np.int32)
    for r in runs:
        start, n = r >> _RUN_BITS, r & ((1 << _RUN_BITS) - 1)
        change[min(start, tokens)] += 1
        change[min(start + n + window - 1, tokens)] -= 1
    return np.cumsum(change[:-1]) > 0
