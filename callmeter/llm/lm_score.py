"""Language-model scores of documents by stupid backoff, with counts over the whole corpus.

``S(w | context) = count(context w) / count(context)`` if the n-gram occurs at least ``least`` times, else ``alpha`` times the score
of the shorter context, down to ``count(w) / N``. The log scores of a document's words are summed. The counted corpus holds the scored
text itself, so no n-gram has count 0: with ``least`` = 2 an n-gram that occurs nowhere else counts as unseen; ``least`` = 1 is the
literal rule, which never backs off inside its own corpus.

The count table is partitioned by hash. Documents are dealt to parts of a few megabytes; a part explodes
its n-grams, combines equal ones, and asks each hash bucket for totals: one row per part and bucket, with the keys (40 bits
within the bucket, in order, as differences) and the part's own counts. A bucket adds up and answers; the answers meet the part's texts, which are shuffled
once. A common n-gram is one entry per part, so no bucket is hot. Two n-grams of a bucket share a key with
a probability of about 2e-6, whatever the corpus size, since buckets have a bounded number of keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.text import Powers, Words, arrow_batches, id_and_text, joined_hash, mix, pieces
from callmeter.runtime import written

ORDER, ALPHA, LEAST = 3, 0.4, 2
PART_BYTES, BUCKET_KEYS = 8 << 20, 1 << 20
_LOW = np.uint64((1 << 40) - 1)


def _ngrams(table: pa.Table, order: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Composite keys (bucket, 40 bits) of every word's n-grams, by order, and each word's row; 0 where a row has too few words."""
    powers, rows, keys, done = Powers(), [], [[] for _ in range(order)], 0
    for batch, data, offsets in pieces(iter(table.combine_chunks().to_batches())):
        words = Words(data, offsets, powers)
        rows.append(words.row + done)
        done += batch.num_rows
        place = np.arange(len(words.row)) - words.first[words.row]
        for n in range(1, order + 1):
            h = mix(joined_hash(words.hash, n) + np.uint64(n))
            out = np.zeros(len(words.row), np.uint64)
            out[n - 1 :] = (h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40) | (h & _LOW)
            out[place < n - 1] = 0
            keys[n - 1].append(out)
    nothing = np.zeros(0, np.uint64)
    return [np.concatenate(k) if k else nothing for k in keys], np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned integers byte plane by byte plane, as many planes as the largest needs (their number first): high planes are mostly zeros, which the shuffle's codec takes out."""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(raw[:, :width].T).tobytes()


def _from_planes(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(packed[0], -1)
    raw = np.zeros((planes.shape[1], 8), np.uint8)
    raw[:, : packed[0]] = planes.T
    return raw.view("<u8").ravel()


def _ask(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        keys, _ = _ngrams(table.select(["text"]), order, buckets)
        own, counts = np.unique(np.concatenate(keys), return_counts=True)
        bucket = (own >> np.uint64(40)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(own) else np.zeros(0, np.int64)
        low = own & _LOW
        cut = list(zip(at.tolist(), [*at[1:].tolist(), len(own)], strict=True)) if len(at) else []
        return pa.table({
            "bucket": pa.array(bucket[at], pa.int64()), "part": pa.array([table.column("part")[0].as_py()] * len(at), pa.int64()),
            "keys": pa.array([_planes(np.diff(low[a:b], prepend=np.uint64(0))) for a, b in cut], pa.binary()), "counts": pa.array([_planes(counts[a:b]) for a, b in cut], pa.binary()),
        })

    return run


def _answer(table: pa.Table) -> pa.Table:
    keys = [np.cumsum(_from_planes(k)) for k in table.column("keys").to_pylist()]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_from_planes(c) for c in table.column("counts").to_pylist()])
    totals = np.bincount(inverse, counts).astype("<u8")[inverse]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).tolist()
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "totals": pa.array([_planes(totals[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())})


def _score(order: int, buckets: int, alpha: float, least: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys, rows = _ngrams(texts.select(["text"]), order, buckets)
        own = np.unique(np.concatenate(keys))
        answers = answers.sort_by("bucket")
        replies = [_from_planes(t) for t in answers.column("totals").to_pylist()]
        totals = (np.concatenate(replies) if replies else np.zeros(0)).astype(np.float64)
        count = [totals[np.searchsorted(own, k)] if len(k) else np.zeros(0) for k in keys]
        known = [k != 0 for k in keys]
        score = np.log(count[0]) if len(rows) else np.zeros(0)  # the corpus size is taken off afterwards
        backed = np.ones(len(rows), bool)
        for n in range(2, order + 1):
            before = np.ones(len(rows))
            before[1:] = count[n - 2][:-1]  # the context ends one word earlier
            has = known[n - 1]
            found = has & (count[n - 1] >= least)
            longer = np.where(found, np.log(np.maximum(count[n - 1], 1)) - np.log(np.maximum(before, 1)), score + np.where(has, np.log(alpha), 0.0))
            backed &= ~found
            score = longer
        n_rows = texts.num_rows
        return pa.table({
            "doc_id": texts.column("doc_id"), "n_words": pa.array(np.bincount(rows, minlength=n_rows), pa.int64()),
            "partial": pa.array(np.bincount(rows, score, n_rows)), "n_unigram": pa.array(np.bincount(rows, backed, n_rows).astype(np.int64)),
        })

    return run


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, part_bytes: int = PART_BYTES, bucket_keys: int = BUCKET_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_unigram, log_score, mean_log_score`` for every row; words are split at white space, case kept.

    ``n_unigram`` counts words that backed off to a single word. A text without words (null, empty) scores 0 with a null mean. Repeated rows are
    counted as often as they occur and scored each; null ids stay; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = max(1, -(-size // part_bytes)), max(1, -(-size * order // (6 * bucket_keys)))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(parts)))
    asked = dealt.groupBy("part").applyInArrow(_ask(order, buckets), "bucket long, part long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, "part long, bucket long, totals binary")
    scored = written(dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score(order, buckets, alpha, least), "doc_id long, n_words long, partial double, n_unigram long"), "scores")
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.col("partial") - F.col("n_unigram") * F.log(F.lit(float(max(words, 1))))
    return scored.select("doc_id", "n_words", "n_unigram", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"))
