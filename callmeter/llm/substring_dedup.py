"""Removal of repeated word passages by relative Lempel-Ziv parsing.

Fragments that may repeat come in blocks (see ``repeats``); a block's fragments are the reference. Each fragment is factored
greedily: at a word, the longest match with an earlier document of the reference becomes a factor, if it has at least 13 words;
else the word is a literal. A factor can end where another source goes on, so the windows that begin in its last twelve
words are looked up as well. Windows inside factors are repeated by construction.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callmeter.llm.repeats import Unit, covered, removed
from callmeter.llm.text import SPACE, Powers, Words, joined_hash

WINDOW, GRAM = 13, 4


def repeats_in(fragments: list[np.ndarray], ids: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each window of each fragment (ascending by id): does a fragment of a smaller id hold it."""
    hashes = [joined_hash(f, window).tolist() for f in fragments]
    earliest: dict[int, tuple[int, int]] = {}  # window -> fragment and place of its first document
    for k, own in enumerate(hashes):
        for place, h in enumerate(own):
            earliest.setdefault(h, (k, place))
    marks = []
    for k, own in enumerate(hashes):
        mark, at, n = np.zeros(len(own), bool), 0, len(own)
        while at < n:
            source, place = earliest[own[at]]
            if ids[source] >= ids[k]:
                at += 1  # a literal
                continue
            size = 1  # windows of the factor: one more for each word that goes on alike
            other = hashes[source]
            while at + size < n and place + size < len(other) and other[place + size] == own[at + size]:
                size += 1
            mark[at : at + size] = True
            at += size  # the next windows begin inside the factor and run over its end: looked up one by one
        marks.append(mark)
    return marks


def _render(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            columns: list[list] = [[] for _ in range(3)]
            for text, runs, copy in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = text.encode()
                words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), powers, SPACE)
                gone = removed(runs, copy, len(words.hash), window)
                kept = b" ".join(data[a:b] for a, b in zip(words.start[~gone].tolist(), words.end[~gone].tolist(), strict=True))
                for c, v in zip(columns, (len(gone), int(gone.sum()), sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_words(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` per row: words in a ``window``-word passage that a smaller id holds go.

    A null text has no words; texts shorter than a window lose nothing; rows that repeat an id do not remove each
    other; a null id compares with nothing; an empty table gives no rows.
    """
    unit = Unit(window, GRAM, words=True)
    return covered(docs, unit, lambda f, i: repeats_in(f, i, window), _render(window), "doc_id long, n_words long, n_removed long, kept_sha256 string", **options)
