"""Collocations against brute force, and the trie's bursts and spills against a plain counter."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callmeter.llm import collocations

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, longest, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = []
    for lang in totals:
        own = []
        for (of, p), a in found.items():
            if of != lang or any(o == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), b in found.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            own.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, totals[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(own)[:top])]
    return sorted(out)


def _rows():
    rng = random.Random(3)
    common = ["the", "of", "New", "york", "CITY", "ünder", "über", "x\x00y"]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            words += rng.choice([["new", "York", "city"], ["over", "the", "moon"], ["a", "a", "a", "a", "a"], ["rare%d" % rng.randrange(900)], [rng.choice(common)], ["machine", "learning"]])
            if rng.random() < 0.1:
                words[-1] += rng.choice([".", ",", "!\n", "\r\n", " ; ", "\x0b"])
        rows.append((rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", "\t", "  "]).join(words)))
    return rows + [("en", None), ("en", ""), ("en", " .,;"), ("xx", "alone"), (None, None), ("en", "a b " * 3000 + ". " + "new york city " * 400)]


def table(spark, rows):
    made = spark.createDataFrame(rows, "lang string, text string").withColumn("id", F.lit(1)).withColumn("n", F.lit("n")).withColumn("phrase", F.lit(None).cast("string"))
    return made.repartition(3)


@pytest.mark.parametrize("options", [{"least": 8}, {"least": 20, "top": 3}, {"least": 3, "burst": 8, "most": 64}])
def test_collocations(spark, options):
    rows = _rows()
    got = collocations.collocations(table(spark, rows), **options)
    assert got.columns == collocations.COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, options["least"], options.get("top", 2000))


def test_nothing_frequent(spark):
    assert collocations.collocations(table(spark, [("en", "one two three")])).collect() == []
    assert collocations.collocations(table(spark, []).limit(0)).collect() == []


def test_long_text_is_cut_at_breaks(spark, monkeypatch):
    data = np.frombuffer(("word by word. " * 500).encode(), np.uint8)
    parts = list(collocations._slices(data, np.array([0, len(data)]), 100))
    assert len(parts) > 50 and b"".join(p.tobytes() for p, _ in parts) == data.tobytes()
    assert all(p.tobytes().rstrip(b" ").endswith(b".") or p is parts[-1][0] for p, _ in parts)


@pytest.mark.parametrize("most", [50, 10**9])
def test_trie_spills_whole_subtrees(most):
    rng = np.random.default_rng(1)
    wanted, trie, runs = Counter(), collocations.HatTrie(3, burst=16), []
    for _ in range(40):
        entries = np.zeros(200, collocations.ENTRY)
        entries["prefix"], entries["last"], entries["n"] = rng.integers(0, 12, 200), rng.integers(0, 9, 200), rng.integers(1, 4, 200)
        entries["phrase"] = collocations.grown(entries["prefix"], entries["last"])
        entries["path"] = (entries["prefix"] % np.uint64(5)) << np.uint64(56) | entries["last"] << np.uint64(48)
        for e in entries:
            wanted[int(e["prefix"]), int(e["last"])] += int(e["n"])
        trie.add(collocations.combined(entries))
        if len(trie) > most:
            runs += list(trie.spill(most // 2))
    runs += list(trie.spill(-1))
    assert len(trie) == 0
    got = Counter()
    for run in runs:
        order = list(zip(run["path"].tolist(), run["phrase"].tolist(), strict=True))
        assert order == sorted(set(order)) and len(set(run["path"] >> np.uint64(56))) == 1
        for e in run:
            got[int(e["prefix"]), int(e["last"])] += int(e["n"])
    assert got == wanted


def test_words_are_worked_out_for_two_megabytes_at_a_time():
    texts = ["some words, " * 20_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 20), pa.array(texts)], names=["lang", "text"])
    sizes = [len(lower) for _, _, lower, _, _ in collocations._sequences([batch])]
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= 1 << 21
