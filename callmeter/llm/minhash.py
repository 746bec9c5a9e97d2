"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A shingle is a point of Z_D with D = 2**32 (``sigma``, the first permutation, spreads
the points). Coordinate k of a signature is the least value of ``pi``, the second permutation,
read at the points shifted by k around the circle: two permutations serve all coordinates.
Bands of coordinates nominate pairs; whole texts decide.

Skew: equal shingle sets fold into one representative before banding. In a
bucket every member is compared with a hub (the member that meets most others), links are contracted
to components, and only members still in different components are compared with
each other, if they have enough shingles that any other such document has and their bitmaps do not
rule the link out. So a bucket of n copies costs n comparisons and loses no link.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmeter.llm.components import components
from callmeter.llm.text import LOWER, Powers, Words, arrow_batches, as_long, id_and_text, joined_hash, mix, pieces, row_sums
from callmeter.runtime import written

SHINGLE = 5
BANDS, BAND_ROWS = 40, 5
LEAST_SHARE = (75, 100)
HUB_ROUNDS = 2
BITMAP_WORDS = 32  # longs in the bitmap of a left-over document
_BLOCK = 1 << 16
PROFILE = "doc_id long, n_shingles long, set_high long, set_low long, keys array<long>"


def shingle_sets(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and where each row's begin.

    A row with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    all_runs = joined_hash(words.hash, width)
    sets, first = [], [0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            own = np.unique(all_runs[a : b - width + 1])
        elif n:
            own = joined_hash(words.hash[a:b], n)
        else:
            own = all_runs[:0]
        sets.append(own)
        first.append(first[-1] + len(own))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array(first)


def signatures(shingles: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: one row per document with shingles, ``size`` coordinates each."""
    rows = np.flatnonzero(np.diff(first))
    out = np.empty((len(rows), size), np.uint32)
    points = (mix(shingles) >> np.uint64(32)).astype(np.uint32)  # sigma
    begin = first[rows]
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + _BLOCK)))
        block, starts = points[begin[i] : first[rows[j - 1] + 1]], begin[i:j] - begin[i]
        value, shifted = np.empty_like(block), np.empty_like(block)
        for k in range(size):
            np.add(block, np.uint32(k), out=value)  # the circle turned by k
            value *= np.uint32(0x85EBCA6B)  # pi
            np.right_shift(value, np.uint32(15), out=shifted)
            value ^= shifted
            value *= np.uint32(0xC2B2AE35)
            np.right_shift(value, np.uint32(13), out=shifted)
            value ^= shifted
            out[i:j, k] = np.minimum.reduceat(value, starts)
        i = j
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    place = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    return mix((parts * place).sum(axis=2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)))


def _profile(bands: int, rows: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches):
            shingles, first = shingle_sets(Words(LOWER[data], offsets, powers), width)
            counts = np.diff(first)
            keys = band_keys(signatures(shingles, first, bands * rows), bands, rows)
            at = np.concatenate([[0], np.cumsum(np.where(counts > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(as_long(row_sums(mix(shingles), first))),
                    pa.array(as_long(row_sums(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), first))),
                    pa.ListArray.from_arrays(at, pa.array(as_long(keys.ravel()))),
                ],
                names=["doc_id", "n_shingles", "set_high", "set_low", "keys"],
            )

    return run


def _word_shingles(text: str, width: int) -> set:
    data = np.frombuffer(text.encode(), np.uint8)
    return set(shingle_sets(Words(LOWER[data], np.array([0, len(data)]), _word_shingles.powers), width)[0].tolist())


_word_shingles.powers = Powers()


def _confirm(width: int, share: tuple[int, int]):
    part, whole = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, set] = OrderedDict()

        def shingles(key: int, text: str) -> set:
            if key not in kept:
                if len(kept) >= 64:
                    kept.popitem(last=False)
                kept[key] = _word_shingles(text, width)
            kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            rows = batch.to_pydict()
            u, v = [], []
            for a, b, text_a, text_b in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
                x, y = shingles(a, text_a), shingles(b, text_b)
                both = len(x & y)
                if both and whole * both >= part * (len(x) + len(y) - both):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE, share: tuple[int, int] = LEAST_SHARE) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets are alike enough, as links ``(u, v)``."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, share), "u long, v long")


def _tokens(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches):
            shingles, first = shingle_sets(Words(LOWER[data], offsets, powers), width)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(first))), pa.array(as_long(shingles))], names=["doc_id", "token"])

    return run


def _lone(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``doc_id, lone``: how many shingles no other of these documents has. They can be in no intersection."""
    tokens = texts.join(ids, "doc_id", "left_semi").mapInArrow(_tokens(width), "doc_id long, token long")
    once = tokens.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).where("doc_id = last")
    return once.groupBy("doc_id").agg(F.count("*").alias("lone"))


def _bitmaps(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch, data, offsets in pieces(batches):
            shingles, first = shingle_sets(Words(LOWER[data], offsets, powers), width)
            bits = np.zeros((batch.num_rows, BITMAP_WORDS * 64), np.uint8)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(first)), mix(shingles) % np.uint64(bits.shape[1])] = 1
            longs = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(longs[:, i].copy()) for i in range(BITMAP_WORDS))], names=["doc_id", *(f"bits{i}" for i in range(BITMAP_WORDS))])

    return run


def _bitmaps_of(ids: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``doc_id, bits0 …``: the bitmap filter of exact set joins. Every bit in which two bitmaps differ stands for at least one
    shingle that just one of the sets has, so many such bits rule a link out, and never one that holds."""
    return texts.join(ids, "doc_id", "left_semi").mapInArrow(_bitmaps(width), "doc_id long, " + ", ".join(f"bits{i} long" for i in range(BITMAP_WORDS)))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, share: tuple[int, int] = LEAST_SHARE, bands: int = BANDS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links with
    ``intersection / union >= share``. Null or empty texts have no shingles and are their own component.
    Rows with the same id are one document each; they share a component when their
    sets are alike. A null id has the null component and is kept. An empty table gives no rows.
    With 40 bands of 5 a pair at exactly 0.75 is missed with probability 2e-5.
    """
    arrow_batches(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col)
    profile = written(texts.mapInArrow(_profile(bands, band_rows, width), PROFILE), "minhash")
    folded = profile.where("n_shingles > 0 and doc_id is not null").groupBy("set_high", "set_low").agg(F.min("doc_id").alias("rep"))
    reps = profile.alias("p").join(folded.alias("f"), [F.col("p.set_high") == F.col("f.set_high"), F.col("p.set_low") == F.col("f.set_low"), F.col("p.doc_id") == F.col("f.rep")], "left_semi")
    entries = reps.dropDuplicates(["doc_id", "set_high", "set_low"]).select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    met = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = written(entries.join(met, "key"), "minhash")

    # Star rounds: in every bucket that holds several components, its next best hub meets the members of the others.
    weight = members.groupBy("doc_id").agg(F.sum(F.col("size") - 1).alias("weight"))
    placed = written(members.join(weight, "doc_id").select("key", "doc_id", "n_shingles", F.struct("weight", (-F.col("doc_id")).alias("minus"), "n_shingles").alias("place"), F.col("doc_id").alias("component")), "minhash")
    links, tried, groups = None, None, None
    alike = f"{share[1]} * least(n_shingles, hub_n) >= {share[0]} * greatest(n_shingles, hub_n)"
    for turn in range(HUB_ROUNDS):
        best = placed.groupBy("key").agg(F.max(F.struct("place", "component")).alias("best"))
        hub = best.select("key", (-F.col("best.place.minus")).alias("hub"), F.col("best.place.n_shingles").alias("hub_n"), F.col("best.component").alias("hub_component"))
        met_hub = placed.join(hub, "key")
        wanted = met_hub.where(f"doc_id <> hub and {alike} and component <> hub_component")
        pairs = wanted.select(F.greatest("hub", "doc_id").alias("a"), F.least("hub", "doc_id").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti") if tried else pairs, "minhash")
        found = written(confirmed(pairs, texts, width, share), "minhash")
        links, tried = (links.union(found), tried.union(pairs)) if tried else (found, pairs)
        if not turn or not found.isEmpty():
            groups = components(links)
        # Go on with the members that are no hub yet, in buckets where these are in several components.
        left = met_hub.where("doc_id <> hub").drop("component").join(groups, F.col("doc_id") == F.col("node"), "left")
        left = left.select("key", "doc_id", "n_shingles", "place", F.coalesce("component", "doc_id").alias("component"))
        open_keys = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        placed = written(left.join(open_keys, "key"), "minhash")
        if placed.isEmpty():
            break
    else:
        # What is left: members that share enough shingles with any other of them.
        members_left = placed.join(_lone(placed.select("doc_id").distinct(), texts, width), "doc_id", "left").withColumn("common", F.expr("n_shingles - coalesce(lone, 0)"))
        left = written(members_left.where(f"{share[1]} * common >= {share[0]} * n_shingles").select("key", "doc_id", "n_shingles", "component", "common"), "minhash")
        left = written(left.join(_bitmaps_of(left.select("doc_id").distinct(), texts, width), "doc_id"), "minhash")
        other = left.select("key", F.col("doc_id").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("component").alias("hub_component"), F.col("common").alias("hub_common"), *(F.col(f"bits{i}").alias(f"hub_bits{i}") for i in range(BITMAP_WORDS)))
        enough = f"{sum(share)} * least(common, hub_common) >= {share[0]} * (n_shingles + hub_n)"
        # A link with share part / whole has at most (whole - part) / (whole + part) of the summed set sizes outside the intersection.
        differing = " + ".join(f"bit_count(bits{i} ^ hub_bits{i})" for i in range(BITMAP_WORDS))
        possible = f"{sum(share)} * ({differing}) <= {share[1] - share[0]} * (n_shingles + hub_n)"
        rest = left.join(other, "key").where(f"doc_id < hub and component <> hub_component and {alike} and {enough} and {possible}").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
        more = written(confirmed(rest.join(tried, ["a", "b"], "left_anti"), texts, width, share), "minhash")
        if not more.isEmpty():
            groups = components(links.union(more))

    of_set = folded.join(groups, folded.rep == groups.node, "left").select("set_high", "set_low", F.coalesce("component", "rep").alias("component_id"))
    sets = profile.select("doc_id", "n_shingles", "set_high", "set_low")
    return (
        sets.where("n_shingles > 0 and doc_id is not null").join(of_set, ["set_high", "set_low"], "left")
        .select("doc_id", "n_shingles", "component_id")
        .union(sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
        .withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id is their component's smallest; of rows with the same id and text one, of different texts under one id each. Rows without an id stay."""
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    # The join leaves the rows partitioned by id, which the second step needs as well.
    one = docs.join(kept, docs[id_col] == kept.kept_id, "left_semi").dropDuplicates([id_col, text_col])
    return one.union(docs.where(F.col(id_col).isNull()))
