"""Collocations: phrases of two to five words counted in HAT-tries, level by level, and scored against their parts.

A word's id is a 64-bit hash of its language and bytes, a phrase's id grows from the id of its first words and the id of its last. Words are counted
first. Then one pass over the texts per length counts the phrases whose two shorter parts are both frequent: no other phrase can be (a part occurs
at least as often). Which ids are frequent is a bitmap of bounded size; a bit set by another id costs a needless count and changes no result.

A task counts in a HAT-trie: branches by the first bits of the first word's id, below them containers of entries in hash order. A container that
outgrows ``BURST`` entries bursts into branches by the next word's id. When a trie holds ``MOST_ENTRIES``, its largest subtrees leave as sorted runs.
Runs are merged by prefix and last word, so the phrases of a common prefix are summed in many tasks. Texts stay where they are; only distinct
phrases of a task move.

Two phrases are taken for one if their 64-bit ids are equal; with a billion distinct phrases that has a chance of a few hundredths, and it matters only where one of the two is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmeter.llm.text import LOWER, Powers, Words, arrow_batches, as_long, mix, pieces
from callmeter.operators.topk import top_rows_per_group
from callmeter.runtime import written

LONGEST, LEAST, TOP = 5, 100, 2000
#: Text bytes looked at together; their words, ids and entries take many times as much.
PIECE_BYTES = 1 << 21
#: Entries (40 bytes each) at which a container bursts, and at which a task's trie spills.
BURST, MOST_ENTRIES = 1 << 15, 1 << 20
#: The bitmap of frequent ids has 16 bits for each, within these bounds (32 MB at most; fuller ones only prune less).
LEAST_BITS, MOST_BITS = 1 << 15, 1 << 28
#: Copies of a table of parts, among which the phrases of a common part are dealt.
SALTS = 8

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True
ENTRY = np.dtype([("path", np.uint64), ("phrase", np.uint64), ("prefix", np.uint64), ("last", np.uint64), ("n", np.int64)])
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def grown(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The id of a phrase from the id of all its words but the last, and the last word's id."""
    return mix(prefix * np.uint64(0x9FB21C651E98DF25) + mix(last ^ np.uint64(0x5851F42D4C957F2D)))


class HatTrie:
    """Counts of phrases of ``length`` words. ``path`` of an entry has a byte per word, the first bits of the words' ids."""

    def __init__(self, length: int, depth: int = 0, burst: int = BURST):
        self.length, self.depth, self.burst = length, depth, burst
        self.held, self.waiting, self.n_waiting = np.zeros(0, ENTRY), [], 0
        self.branches: dict[int, HatTrie] | None = {} if depth == 0 else None

    def __len__(self) -> int:
        return sum(map(len, self.branches.values())) if self.branches is not None else len(self.held) + self.n_waiting

    def add(self, entries: np.ndarray) -> None:
        """Entries in order of their path."""
        if self.branches is not None:
            self._deal(entries)
            return
        self.waiting.append(entries)
        self.n_waiting += len(entries)
        if self.n_waiting > max(len(self.held), 1024):
            self._settle()
            if len(self.held) > self.burst and self.depth < self.length:
                self.branches = {}
                self._deal(self.held)
                self.held = self.held[:0]

    def _deal(self, entries: np.ndarray) -> None:
        digit = (entries["path"] >> np.uint64(56 - 8 * self.depth)) & np.uint64(255)
        at = np.flatnonzero(np.concatenate([[True], digit[1:] != digit[:-1], [True]])) if len(entries) else [0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            branch = self.branches.get(int(digit[a]))
            if branch is None:
                branch = self.branches[int(digit[a])] = HatTrie(self.length, self.depth + 1, self.burst)
            branch.add(entries[a:b].copy())  # a view would keep the whole batch alive

    def _settle(self) -> None:
        if self.waiting:
            self.held = combined(np.concatenate([self.held, *self.waiting]))
            self.waiting, self.n_waiting = [], 0

    def run(self) -> np.ndarray:
        """All entries, combined and in order of path and phrase."""
        if self.branches is not None:
            parts = [self.branches[digit].run() for digit in sorted(self.branches)]
            return np.concatenate(parts) if parts else np.zeros(0, ENTRY)
        self._settle()
        return self.held

    def spill(self, most: int) -> Iterator[np.ndarray]:
        """Sorted runs of the largest subtrees, which leave the trie until it holds at most ``most`` entries."""
        for digit in sorted(self.branches, key=lambda d: -len(self.branches[d])):
            if len(self) <= most:
                break
            yield self.branches.pop(digit).run()


def combined(entries: np.ndarray) -> np.ndarray:
    """Entries in order of path and phrase, the counts of equal ones added."""
    entries = entries[np.lexsort((entries["phrase"], entries["path"]))]
    if len(entries) < 2:
        return entries
    first = np.flatnonzero(np.concatenate([[True], (entries["phrase"][1:] != entries["phrase"][:-1]) | (entries["path"][1:] != entries["path"][:-1])]))
    out = entries[first]
    out["n"] = np.add.reduceat(entries["n"], first)
    return out


def _slices(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A piece, or a single long text cut where phrases end anyway."""
    if len(data) <= 2 * most:
        yield data, offsets
        return
    ends, start = np.flatnonzero(BREAK[data]) + 1, 0
    while start < len(data):
        at = int(np.searchsorted(ends, start + most))
        end = int(ends[at]) if at < len(ends) else len(data)
        yield data[start:end], np.array([0, end - start])
        start = end


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of rows: languages, words, lower-cased bytes, word ids, and whether a word's successor is in the same piece of the text."""
    powers = Powers()
    for batch, data, offsets in pieces(batches, most=PIECE_BYTES):
        langs = batch.column(0)
        salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], np.uint64)
        for part, own in _slices(data, offsets, PIECE_BYTES):
            lower = LOWER[part]
            words = Words(lower, own, powers, SEPARATOR)
            ends = np.cumsum(BREAK[part], dtype=np.int32)[words.start]
            yield langs, words, lower, mix(words.hash ^ salt[words.row]), (ends[1:] == ends[:-1]) & (words.row[1:] == words.row[:-1])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, words, lower, ids, _ in _sequences(batches):
        own, first, n = np.unique(ids, return_index=True, return_counts=True)
        size = words.end[first] - words.start[first]
        at = np.concatenate([[0], np.cumsum(size)])
        letters = lower[np.repeat(words.start[first] - at[:-1], size) + np.arange(at[-1])]
        word = pa.StringArray.from_buffers(len(first), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(letters.tobytes()))
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(words.row[first])), word, pa.array(as_long(own)), pa.array(n, pa.int64())], names=["lang", "word", "id", "n"])


def _count_phrases(length: int, frequent, burst: int, most: int):
    """``prefix, last, n`` of the phrases of ``length`` words that the bitmap of shorter ones lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(frequent.value, np.uint8)
        last_bit = np.uint64(len(bitmap) * 8 - 1)
        trie = HatTrie(length, burst=burst)

        def sent(entries: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(entries), 1 << 16):
                part = entries[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(as_long(np.ascontiguousarray(part[c]))) for c in ("prefix", "last")] + [pa.array(np.ascontiguousarray(part["n"]))], names=["prefix", "last", "n"])

        for *_, ids, linked in _sequences(batches):
            if len(ids) < length:
                continue
            prefix, whole = ids, linked
            for j in range(1, length - 1):
                prefix = grown(prefix[:-1], ids[j:])
                whole = whole[:-1] & linked[j:]
            bit = prefix & last_bit
            known = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0
            at = np.flatnonzero(whole & known[:-1] & known[1:])
            entries = np.empty(len(at), ENTRY)
            entries["prefix"], entries["last"], entries["n"] = prefix[at], ids[at + length - 1], 1
            entries["phrase"] = grown(entries["prefix"], entries["last"])
            entries["path"] = 0
            for j in range(length):
                entries["path"] |= (ids[at + j] >> np.uint64(56)) << np.uint64(56 - 8 * j)
            trie.add(combined(entries))
            if len(trie) > most:
                for subtree in trie.spill(most // 2):
                    yield from sent(subtree)
        for subtree in trie.spill(-1):
            yield from sent(subtree)

    return run


def _with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the id of a phrase and of the phrase without its first word, from the ids of its words."""
    for batch in batches:
        words = batch.column(batch.schema.get_field_index("ids"))
        ids = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
        suffix = ids[:, 1]
        for j in range(2, ids.shape[1]):
            suffix = grown(suffix, ids[:, j])
        prefix = batch.column(batch.schema.get_field_index("prefix")).to_numpy().view(np.uint64)
        for name, values in (("id", grown(prefix, ids[:, -1])), ("suffix", suffix)):
            batch = batch.append_column(name, pa.array(as_long(np.ascontiguousarray(values))))
        yield batch


def _bitmap(frequent: DataFrame) -> bytes:
    """Which ids occur, by their last bits."""
    bits = LEAST_BITS
    wanted = min(16 * frequent.count(), MOST_BITS)
    while bits < wanted:
        bits *= 2
    place = F.col("id").bitwiseAND(F.lit(bits - 1)) + 1
    # At most MOST_BITS / 8 bytes, whatever the number of ids.
    rows = frequent.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = bytearray(bits // 8)
    for row in rows:
        begin = (row.bucket - 1) * (LEAST_BITS // 8)
        out[begin : begin + len(row.bits)] = row.bits
    return bytes(out)


def _meet(phrases: DataFrame, parts: DataFrame, by: str, other: str) -> DataFrame:
    """Join on ``by``; the phrases of one part are dealt to copies of it by their ``other`` part."""
    dealt = phrases.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    copies = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [by, "salt"]).drop("salt")


def frequent_phrases(texts: DataFrame, longest: int = LONGEST, least: int = LEAST, burst: int = BURST, most: int = MOST_ENTRIES) -> tuple[list[DataFrame], DataFrame]:
    """Tables by length of the phrases of ``texts(lang, text)`` that occur at least ``least`` times, and ``lang, total`` words.

    A table has ``lang, phrase, n, id, prefix, suffix, ids, heads, tails``: ``heads`` counts the phrases of its first 1, 2, … words, ``tails`` those of its last.
    """
    spark = texts.sparkSession
    words = written(texts.mapInArrow(_count_words, "lang string, word string, id long, n long").groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "words")
    one = F.array("n")
    tables = [words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n", "id", F.array("id").alias("ids"), one.alias("heads"), one.alias("tails"))]
    for length in range(2, longest + 1):
        shorter = tables[-1]
        bitmap = spark.sparkContext.broadcast(_bitmap(shorter.select("id")))
        runs = texts.mapInArrow(_count_phrases(length, bitmap, burst, most), "prefix long, last long, n long")
        counts = written(runs.groupBy("prefix", "last").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")
        heads = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("before"), "ids", "heads")
        begun = _meet(counts, heads, "prefix", "last").select("prefix", "lang", "before", F.concat("ids", F.array("last")).alias("ids"), F.concat("heads", F.array("n")).alias("heads"), "n")
        both = begun.mapInArrow(_with_ids, begun.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", id long, suffix long")
        tails = shorter.select(F.col("id").alias("suffix"), F.col("phrase").alias("after"), "tails")
        whole = _meet(both, tails, "suffix", "prefix").select(
            "lang", F.concat_ws(" ", "before", F.substring_index("after", " ", -1)).alias("phrase"), "n", "id", "prefix", "suffix", "ids", "heads", F.concat("tails", F.array("n")).alias("tails"),
        )
        tables.append(written(whole, "phrases"))
        if tables[-1].isEmpty():
            break
    return tables, words.groupBy("lang").agg(F.sum("n").alias("total"))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, burst: int = BURST, most: int = MOST_ENTRIES
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language.

    Words are split at blanks and tabs, phrases never cross ``. , ; : ! ?`` or a line end, A-Z count as a-z. A phrase of 2 to ``longest`` words with ``a >= least``
    occurrences is scored by its worst cut, ``floor(1000 * a * n / (l * r))`` in exact decimals, the first of equals. A phrase goes that lies in a longer one with as
    many occurrences; since counts fall along the way, one more word is enough to look at. A null language is ``und``, a null or empty text has no words, repeated
    rows and null ids count like any others. Other columns stay out; an empty table gives no rows. A text longer than a piece is cut
    at its own breaks, so memory is bounded unless a text has none for megabytes.
    """
    arrow_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tables, totals = frequent_phrases(texts, longest, least, burst, most)
    cut = F.expr(
        "array_min(transform(sequence(1, size(ids) - 1), k -> struct("
        "(1000 * cast(n as decimal(19, 0)) * cast(total as decimal(19, 0))) div (cast(heads[k - 1] as decimal(19, 0)) * cast(tails[size(ids) - k - 1] as decimal(19, 0))) as score, "
        "k, heads[k - 1] as l, tails[size(ids) - k - 1] as r)))"
    )
    kept = None
    for i in range(1, len(tables)):
        own = tables[i]
        if i + 1 < len(tables):
            longer = tables[i + 1]
            within = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("n").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
            own = own.join(within, "id", "left").where("most is null or most < n").drop("most")
        kept = own if kept is None else kept.unionByName(own)
    scored = kept.join(totals, "lang").withColumn("cut", cut).select(
        "lang", "phrase", F.col("n").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("total").alias("n"), F.col("cut.score").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_rows_per_group(scored, ["lang"], order, top, ["phrase"])
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).select(*COLUMNS)
