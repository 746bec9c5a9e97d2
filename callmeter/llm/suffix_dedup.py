"""Removal of long repeated byte strings, with a run-length index (a run-compressed Burrows-Wheeler transform).

Fragments that may repeat come in blocks (see ``repeats``). A block's fragments are sorted as one text; its transform is stored
as runs with the text position of each run's end. Every fragment is streamed from its last byte to its first through
the index by LF steps over the runs, all fragments in step; the row reached tells which class of equal 50-byte prefixes its suffix is in, and the
class, the smallest document that has it. The matching statistic of a place is at least 50 against an earlier document exactly if that
is smaller than the fragment's own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callmeter.llm.repeats import Unit, covered, removed

WINDOW, GRAM = 50, 16


@dataclass
class RunIndex:
    run_starts: np.ndarray  # first row of each run
    run_leads: np.ndarray  # LF of that row
    run_ends: np.ndarray  # text position at each run's last row
    classes: np.ndarray  # first row of each class of equal prefixes
    smallest: np.ndarray  # the smallest document of a class
    last_rows: np.ndarray  # row of each fragment's end

    @classmethod
    def build(cls, fragments: list[np.ndarray], ids: np.ndarray, window: int) -> RunIndex:
        """Prefix doubling over the joined fragments, ever fewer of whose places are sorted; their ends are one symbol below all bytes."""
        sizes = np.array([len(f) for f in fragments])
        ends = np.cumsum(sizes + 1) - 1
        text = np.zeros(ends[-1] + 1, np.int64)
        mask = np.ones(len(text), bool)
        mask[ends] = False
        text[mask] = np.concatenate(fragments).astype(np.int64) + 1
        seven = text.copy()  # seven symbols of nine bits in one key
        for j in range(1, 7):
            seven *= 512
            seven[:-j] += text[j:]
        (rank, ties), depth = cls._ranks(seven), 7
        while depth < window:
            by = min(depth, window - depth)
            (rank, ties), depth = cls._deeper(rank, ties, by), depth + by
        prefix = rank
        while len(ties):
            (rank, ties), depth = cls._deeper(rank, ties, depth), depth * 2
        order = np.empty(len(text), np.int64)  # the suffix array, dropped after the build
        order[rank] = np.arange(len(text))
        heads = text[order - 1]
        run_starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
        lengths = np.diff(np.append(run_starts, len(text)))
        by_head = np.argsort(heads[run_starts], kind="stable")
        leads = np.empty(len(run_starts), np.int64)
        leads[by_head] = np.concatenate([[0], np.cumsum(lengths[by_head])[:-1]])
        owner = np.repeat(ids, sizes + 1)
        sorted_prefix = prefix[order]
        classes = np.flatnonzero(np.concatenate([[True], sorted_prefix[1:] != sorted_prefix[:-1]]))
        return cls(run_starts, leads, order[run_starts + lengths - 1], classes, np.minimum.reduceat(owner[order], classes), rank[ends])

    @staticmethod
    def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many keys are smaller, for each; and the places whose key is not the only one of its kind."""
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        sizes = np.diff(np.append(first, len(keys)))
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.repeat(first, sizes)
        return rank, order[np.repeat(sizes > 1, sizes)]

    @staticmethod
    def _deeper(rank: np.ndarray, ties: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by ``by`` more symbols. Only places that share their rank are sorted again: all others have their final one."""
        if not len(ties):
            return rank, ties
        after = np.append(rank + 1, 0)[np.minimum(ties + by, len(rank))]
        keys = rank[ties] * (len(rank) + 2) + after
        order = np.argsort(keys)
        ties, keys = ties[order], keys[order]
        old = rank[ties]
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(first, len(ties)))
        begins = group[np.searchsorted(group, first, side="right") - 1]
        out = rank.copy()
        out[ties] = np.repeat(old[first] + first - begins, sizes)
        return out, ties[np.repeat(sizes > 1, sizes)]

    def step(self, rows: np.ndarray) -> np.ndarray:
        """LF: the rows of the suffixes that begin one position earlier."""
        run = np.searchsorted(self.run_starts, rows, side="right") - 1
        return self.run_leads[run] + rows - self.run_starts[run]

    def earliest(self, rows: np.ndarray) -> np.ndarray:
        return self.smallest[np.searchsorted(self.classes, rows, side="right") - 1]


def repeats_in(fragments: list[np.ndarray], ids: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each fragment: does a fragment of a smaller id hold it."""
    index = RunIndex.build(fragments, ids, window)
    sizes = np.array([len(f) for f in fragments])
    marks = [np.zeros(max(0, s - window + 1), bool) for s in sizes.tolist()]
    flat = np.zeros(sum(map(len, marks)), bool)
    base = np.concatenate([[0], np.cumsum([len(m) for m in marks])[:-1]])
    rows, left, active = index.last_rows, sizes.copy(), np.arange(len(fragments))
    while len(active):
        rows = index.step(rows)
        left[active] -= 1
        at = left[active]
        full = at + window <= sizes[active]
        who = active[full]
        flat[base[who] + at[full]] = index.earliest(rows[full]) < ids[who]
        going = at > 0
        rows, active = rows[going], active[going]
    return [flat[b : b + len(m)] for b, m in zip(base.tolist(), marks, strict=True)]


def _render(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for text, runs, copy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                gone = removed(runs, copy, len(data), window)
                spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                for c, v in zip(columns, (len(data), int(gone.sum()), spans, sha256(data[~gone].tobytes()).hexdigest()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_bytes(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row: bytes in a ``window``-byte string that a smaller id holds go.

    A null text counts as empty; texts shorter than a window lose nothing; rows that repeat an id do not remove each
    other; a null id compares with nothing; an empty table gives no rows.
    """
    unit = Unit(window, GRAM, words=False)
    return covered(docs, unit, lambda f, i: repeats_in(f, i, window), _render(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)
