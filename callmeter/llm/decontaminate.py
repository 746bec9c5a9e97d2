"""Benchmark passages in documents, by SimHash windows and multi-index Hamming blocks; DataFrame functions only.

Words are runs of letters and digits, lower-cased. An item of m words belongs to a class by its size: windows of 8 pairs
of neighbouring words (m >= 12), or of 4 pairs, one shingle (5 <= m < 12). Item windows start at every word, document windows
at every third or every word, so a copy holds a document window that equals an item window as long as 11 words in a row
(or one shingle) are unchanged; similarity 0.75 leaves that many unless the lost shingles are much lighter than the others.
A window's fingerprint is the 64-bit majority (SimHash) of eight features, its pairs once or twice.
Fingerprints within ``RADIUS`` bits agree on at least one of RADIUS + 1 blocks, so equality on a block finds them all.
Each candidate is then compared with the whole item at the place where the two line up and at the places up to a quarter of the
item before and after it: 5-word shingles weighted by their letters, ``shared weight / total weight >= 0.75``.
An item of 1 to 4 words is one shingle as a whole: one feature, which is its fingerprint, and similarity 1 or 0. Windows of its
size at every word meet it by that fingerprint, then by their words.

The index of benchmark windows is broadcast in slices of at most ``SLICE_WORDS`` words, whatever the benchmark's
size; documents are never shuffled before a window has matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ((8, 3, 12, None), (4, 1, 5, 12))  # pairs in a window, words between document windows, items from, items below
BLOCKS = 4
RADIUS = BLOCKS - 1
SHINGLE, LEAST_SIMILARITY = 5, 0.75
SLICE_WORDS = 200_000
BETWEEN_WORDS = "[^\\p{L}\\p{N}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN_WORDS), "")


def _majority(df: DataFrame, features: str, at: str, out: str, pairs: int) -> DataFrame:
    """The bitwise majority of ``pairs`` (8, or 4 taken twice) features from ``at`` on: counts in bit planes, four of eight decided by the last."""

    def step(frame: DataFrame, **columns: str) -> DataFrame:
        return frame.withColumns({k: F.expr(v) for k, v in columns.items()})

    add = "({0} & {1}) | (({0} ^ {1}) & {2})"
    df = step(df, **{f"x{i}": f"{features}[{at} + {i * pairs // 8}]" for i in range(8)})
    df = step(df, s1="x0 ^ x1 ^ x2", c1=add.format("x0", "x1", "x2"), s2="x3 ^ x4 ^ x5", c2=add.format("x3", "x4", "x5"))
    df = step(df, s3="s1 ^ s2 ^ x6", c3=add.format("s1", "s2", "x6"))
    df = step(df, ones="s3 ^ x7", c4="s3 & x7", t1="c1 ^ c2 ^ c3", d1=add.format("c1", "c2", "c3"))
    df = step(df, twos="t1 ^ c4", d2="t1 & c4")
    df = step(df, **{out: "(d1 & d2) | ((d1 ^ d2) & (twos | ones | x7))"})
    return df.drop(*[f"x{i}" for i in range(8)], "s1", "s2", "s3", "c1", "c2", "c3", "c4", "t1", "d1", "d2", "ones", "twos")


def _with_block(df: DataFrame, print_: str) -> DataFrame:
    """A row for each block of the fingerprint: its number and value in one key."""
    width = 64 // BLOCKS
    keys = [F.expr(f"(shiftrightunsigned({print_}, {width * b}) & {(1 << width) - 1}) | {b << width}") for b in range(BLOCKS)]
    return df.withColumn("block", F.explode(F.array(*keys)))


def _windows(df: DataFrame, pairs: int, stride: int) -> DataFrame:
    """Rows ``start, print`` for windows at multiples of ``stride`` words; needs ``words``, keeps all columns."""
    features = F.zip_with(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"), lambda a, b: F.xxhash64(a, b))
    df = df.where(f"size(words) > {pairs}").withColumn("features", features)
    df = df.withColumn("start", F.explode(F.expr(f"sequence(0, size(features) - {pairs}, {stride})")))
    return _majority(df, "features", "start", "print", pairs).drop("features")


def _item_windows(items: DataFrame, pairs: int) -> DataFrame:
    """Windows of an item at every word."""
    return _windows(items, pairs, 1).select("item_id", F.size("words").alias("m"), F.col("start").alias("offset"), F.col("print").alias("item_print"))


def _shingles(words: str | Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - SHINGLE + 1)), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def _weight(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, s: acc + F.length(s).cast("long"))


def _whole(texts: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """``doc_id, item_id, start_word`` of items too short for a shingle, at their first place."""
    index = items.where(f"size(words) < {SHINGLE}").select("item_id", F.col("words").alias("own"), F.xxhash64("words").alias("own_print")).distinct()
    piece = F.expr("slice(words, start + 1, m)")
    placed = texts.withColumn("m", F.explode(F.array(*map(F.lit, sizes)))).where("size(words) >= m").withColumn("start", F.explode(F.expr("sequence(0, size(words) - m)")))
    met = placed.withColumn("print", F.xxhash64(piece)).join(F.broadcast(index), (F.col("print") == F.col("own_print")) & (piece == F.col("own")))
    return met.groupBy("doc_id", "item_id").agg(F.min("start").alias("start_word"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = LEAST_SIMILARITY, slice_words: int = SLICE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start_word, similarity`` of every benchmark item found in a document, at its best place.

    Null or empty texts hold nothing, and items without words are in no text. Repeated rows of a document give one row; repeated items one each id. A null id matches under
    a null id; different texts under one id are searched each. Other columns, whatever their names, stay out. Empty tables give no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text_col)).alias("words"))
    return _found(texts, benchmark, similarity, slice_words)


def _found(texts: DataFrame, benchmark: DataFrame, similarity: float = LEAST_SIMILARITY, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``leaks`` of rows ``doc_id`` (of any type), ``words``."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where("size(words) > 0")
    size, least = F.size("words"), CLASSES[0][2]
    total, shorter, short_sizes = items.agg(F.sum(size), F.count_if(size.between(SHINGLE, least - 1)), F.collect_set(F.when(size < SHINGLE, size))).first()
    slices = max(1, -(-(total or 0) // slice_words))
    found, whole = [], []
    for n in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(slices)) == n)
        if short_sizes:
            whole.append(_whole(texts, part, sorted(short_sizes)))
        for pairs, stride, low, high in CLASSES if shorter else CLASSES[:1]:
            own = part.where(f"size(words) >= {low}" + (f" and size(words) < {high}" if high else ""))
            index = _with_block(_item_windows(own, pairs), "item_print").dropDuplicates(["item_id", "m", "block", "item_print", "offset"])
            probes = _with_block(_windows(texts, pairs, stride), "print")
            # coalesce: without it an inferred null check would be pushed below the adders and expand them.
            met = probes.join(F.broadcast(index), "block").where(f"bit_count(coalesce(print, 0L) ^ coalesce(item_print, 0L)) <= {RADIUS}")
            met = met.withColumn("reach", F.expr("int(ceil(m / 4))")).withColumn("from_word", F.greatest(F.expr("start - offset - reach"), F.lit(0)))
            found.append(met.select("doc_id", "item_id", "m", "from_word", F.expr("slice(words, from_word + 1, start - offset + m + reach - from_word)").alias("around")))
    candidates = reduce(DataFrame.union, found).distinct()
    # Few bytes, much work: a fixed number of partitions is not joined to a few by their size.
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = candidates.repartition(spread, "doc_id", "item_id", "from_word")
    wording = items.where(f"size(words) >= {SHINGLE}").select(F.col("item_id").alias("known"), F.col("words").alias("item_words")).distinct()
    both = candidates.join(wording, candidates.item_id.eqNullSafe(wording.known) & (F.size("item_words") == F.col("m"))).withColumn("b", _shingles("item_words"))
    # What the surroundings lack of the item, no place in them has.
    near = both.where(_weight(F.array_intersect(_shingles("around"), "b")) >= similarity * _weight(F.array_distinct("b")))
    places = near.withColumn("place", F.explode(F.expr("sequence(0, greatest(size(around) - m, 0))"))).withColumn("a", _shingles(F.expr("slice(around, place + 1, m)"))).withColumn("start_word", F.col("from_word") + F.col("place"))
    scored = places.withColumn("similarity", _weight(F.array_intersect("a", "b")) / _weight(F.array_union("a", "b"))).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start_word")).alias("minus"))).alias("best"))
    best = best.select("doc_id", "item_id", (-F.col("best.minus")).alias("start_word"), F.col("best.similarity").alias("similarity"))
    return reduce(DataFrame.union, [best, *(w.withColumn("similarity", F.lit(1.0)) for w in whole)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item. Each row is judged by its own text: also without an id, or when another text has the same id."""
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    bad = _found(docs.select(row.alias("doc_id"), _words(F.col(text_col)).alias("words")), benchmark, **options)
    bad = bad.select(F.col("doc_id.id").alias("leaking_id"), F.col("doc_id.text").alias("leaking_text")).distinct()
    same = docs[id_col].eqNullSafe(bad.leaking_id) & (F.xxhash64(docs[text_col]) == bad.leaking_text)
    return docs.join(bad, same, "left_anti")
