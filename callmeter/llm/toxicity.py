"""Severity of toxic language by cumulative-link ordinal regression on hashed word features.

``P(grade > k | x) = sigmoid(w·x - theta_k)`` with one weight vector ``w`` for all ordered thresholds
``theta_1 < theta_2 < …``. The output is the expected grade, the sum of these
probabilities. A feature is the presence of a word (letters only, A-Z lower-cased, hashed into a fixed
number of slots); absent words cost nothing.

Fitting uses a bounded sample of labelled rows (``FIT_ROWS``, taken by hash of the id); scoring reads
every whole text. The weights are one array of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.text import LOWER, Powers, Words, arrow_batches, id_and_text, pieces

SLOTS = 1 << 18
FIT_ROWS = 10_000
EPOCHS, LEARNING_RATE, SHRINK, LEAST_ROWS, LEAST_DEVIATION = 20, 0.1, 1e-5, 5, 5.0
REJECT_FROM = 0.5  # expected severity

# Whatever is no letter separates words here: ASCII punctuation, digits and white space.
_NO_LETTER = np.zeros(256, bool)
_NO_LETTER[:128] = [not chr(i).isalpha() for i in range(128)]


def _slots(data: np.ndarray, offsets: np.ndarray, powers: Powers, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every distinct (row, slot) pair."""
    words = Words(LOWER[data], offsets, powers, _NO_LETTER)
    pair = np.unique(words.row.astype(np.uint64) * np.uint64(slots) + words.hash % np.uint64(slots))
    return (pair // np.uint64(slots)).astype(np.int64), (pair % np.uint64(slots)).astype(np.int64)


@dataclass
class SeverityModel:
    weights: np.ndarray  # float32, one per slot
    thresholds: np.ndarray  # ascending

    def expected(self, data: np.ndarray, offsets: np.ndarray, powers: Powers) -> np.ndarray:
        rows, slots = _slots(data, offsets, powers, len(self.weights))
        margin = np.bincount(rows, self.weights[slots], len(offsets) - 1)
        return (1 / (1 + np.exp(self.thresholds[:, None] - margin))).sum(axis=0)


def _fit(cols: np.ndarray, sizes: np.ndarray, grades: np.ndarray, slots: int) -> SeverityModel:
    """Adaptive gradient descent over shuffled blocks; deterministic for given rows, each ``sizes`` slots of ``cols``."""
    levels = int(grades.max()) if len(grades) else 0
    if not levels:
        return SeverityModel(np.zeros(slots, np.float32), np.full(1, 30.0))
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    # Only words that go with a grade far beyond chance: others would be learnt by heart.
    held, share = np.bincount(cols, minlength=slots), (grades > 0).mean()
    beyond = (np.bincount(cols, (grades > 0)[rows], slots) - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    telling = ((held >= LEAST_ROWS) & (np.abs(beyond) >= LEAST_DEVIATION))[cols]
    rows, cols = rows[telling], cols[telling].astype(np.int64)
    first = np.searchsorted(rows, np.arange(len(grades) + 1))
    above = (grades[:, None] > np.arange(levels)).astype(np.float64)
    share = np.clip(above.mean(axis=0), 1e-6, 1 - 1e-6)
    theta = np.log(1 / share - 1)
    w, w_square, t_square = np.zeros(slots), np.full(slots, 1e-8), np.full(levels, 1e-8)
    balance = np.where(grades > 0, 0.5 / max((grades > 0).mean(), 1e-6), 0.5 / max((grades == 0).mean(), 1e-6))
    random = np.random.default_rng(7)
    for _ in range(EPOCHS):
        order = random.permutation(len(grades))
        for i in range(0, len(order), 64):
            block = order[i : i + 64]
            sizes = first[block + 1] - first[block]
            at = np.repeat(first[block] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            own, col = np.repeat(np.arange(len(block)), sizes), cols[at]
            margin = np.bincount(own, w[col], len(block))
            miss = (1 / (1 + np.exp(np.clip(theta - margin[:, None], -60, 60))) - above[block]) * balance[block, None]
            touched, inverse = np.unique(col, return_inverse=True)
            slope = np.bincount(inverse, miss.sum(axis=1)[own]) / len(block) + SHRINK * w[touched]
            w_square[touched] += slope**2
            w[touched] -= LEARNING_RATE * slope / np.sqrt(w_square[touched])
            slope = -miss.mean(axis=0)
            t_square += slope**2
            theta = np.sort(theta - LEARNING_RATE * slope / np.sqrt(t_square))
    return SeverityModel(w.astype(np.float32), theta)


def fit_severity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, slots: int = SLOTS) -> SeverityModel:
    """Fit on at most ``rows`` labelled documents.

    Grades: 0 not toxic, 1 toxic in text of good quality, 2 toxic in text of bad quality; a null toxic
    label leaves the row out, a null quality counts as good. Several labels of one document: the highest
    grade. The sample is the ``rows`` labelled ids with the lowest hashes, split in the same
    way however tables are partitioned.
    """
    graded = (
        labels.where("toxic is not null and doc_id is not null")
        .select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1).alias("grade"))
        .groupBy("doc_id").agg(F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    texts = id_and_text(docs).where("doc_id is not null")
    sample = texts.join(F.broadcast(graded), "doc_id").select("doc_id", "text", "grade")
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches):
            own, held = _slots(data, offsets, powers, slots)
            bounds = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(bounds, pa.array(held, pa.int32()))], names=["doc_id", "grade", "slots"])

    # Features of a bounded sample of rows, so they may go to the driver; texts stay with the tasks.
    found = sample.mapInArrow(run, "doc_id long, grade int, slots array<int>").toArrow()
    found = found.take(np.argsort(found.column("doc_id").to_numpy(), kind="stable"))
    lists = found.column("slots").combine_chunks()
    return _fit(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False), found.column("grade").to_numpy().astype(np.int64), slots)


def severity(docs: DataFrame, model: SeverityModel, reject_from: float = REJECT_FROM) -> DataFrame:
    """``doc_id, severity, toxic`` for every row: the expected grade, and whether it reaches ``reject_from``.

    A null or empty text has no features and gets the grade of the thresholds alone; repeated rows
    are scored alike; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches):
            grade = shared.value.expected(data, offsets, powers)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(grade >= reject_from)], names=["doc_id", "severity", "toxic"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, severity double, toxic boolean")


def without_toxic(docs: DataFrame, model: SeverityModel, reject_from: float = REJECT_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose expected grade is below ``reject_from``.

    Each row is judged by its own text, so rows without an id or with a repeated one are no special case, and nothing is shuffled.
    A null text counts as empty and stays null.
    """
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pc.fill_null(batch.column(at), ""), pa.array(np.arange(batch.num_rows))], names=["text", "row"])
            for piece, data, offsets in pieces(iter([texts])):
                stays = shared.value.expected(data, offsets, powers) < reject_from
                rows = batch.slice(piece.column(1)[0].as_py(), piece.num_rows).filter(pa.array(stays))
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays(rows.columns, names=names)

    return docs.mapInArrow(run, docs.schema)
