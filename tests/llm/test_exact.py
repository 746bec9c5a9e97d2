"""Queries against brute force on small fixtures: all rows, nulls, ties, long and repeated texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callmeter.llm import decontaminate, fingerprint, licenses, lm_score, minhash, packing, repeats, substring_dedup, suffix_dedup
from callmeter.llm.text import Powers

SF = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents, and awkward rows: null, empty, short, periodic, very long, copies; columns with clashing names."""
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    phrase = " ".join(f"w{i}" for i in range(40))
    odd = [None, "", " ", "a", "one two three four", "ab " * 400, "ab " * 400, "x" * 5000, "x" * 300, phrase, f"début {phrase} fin", f"{phrase} {phrase}", "ünï " * 30, " ".join(f"t{i % 997}" for i in range(60_000)), "Under the MIT License. cc by NC", "\t a\n b <|endoftext|> c  d"]
    rows = [(10_000 + 3 * i, t) for i, t in enumerate(odd)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return given.union(made).withColumn("hub", F.lit(1)).withColumn("h", F.lit("x")).withColumn("part", F.lit(2)).withColumn("key", F.lit(None).cast("string")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def _repeats(texts, tokens, window):
    seen, out = {}, {}
    for doc in sorted(texts):
        own = tokens(texts[doc])
        gone, new = [False] * len(own), []
        for a in range(len(own) - window + 1):
            g = tuple(own[a : a + window])
            if seen.get(g, doc) < doc:
                gone[a : a + window] = [True] * window
            new.append(g)
        for g in new:
            seen.setdefault(g, doc)
        out[doc] = own, gone
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix_dedup(docs, texts, hot):
    wanted = {}
    for doc, (own, gone) in _repeats(texts, lambda t: t.encode(), 50).items():
        spans = len([s for s in "".join(" x"[g] for g in gone).split() if s])
        wanted[doc] = len(own), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(own, gone, strict=True) if not g)).hexdigest()
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs, hot=hot).collect()}
    assert found == wanted


@pytest.mark.parametrize("hot", [1000, 1])
def test_substring_dedup(docs, texts, hot):
    wanted = {d: (len(own), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(own, gone, strict=True) if not g).encode()).hexdigest()) for d, (own, gone) in _repeats(texts, WORDS.findall, 13).items()}
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_words(docs, hot=hot).collect()}
    assert found == wanted


def test_long_runs_are_cut(monkeypatch):
    """Every window of periodic and other rows is in one fragment, and each fragment's length fits its bits."""
    unit = repeats.Unit(window=50, gram=8, words=False)
    row = [b"x" * 5000, b"ab" * 40, b"x" * 64, b"x" * 112, b"short"]
    data, offsets = np.frombuffer(b"".join(row), np.uint8), np.cumsum([0, *map(len, row)])
    codes, first = unit.tokens(data, offsets, Powers())
    whole = repeats.fragments(codes, first, unit, Powers())
    monkeypatch.setattr(repeats, "_RUN_BITS", 4)
    h, f, rows, start, n = repeats.fragments(codes, first, unit, Powers())
    assert n.max() < 1 << 4
    windows = lambda h, rows, start, n: [(r, s + k, x) for x, r, s, m in zip(h.tolist(), rows.tolist(), start.tolist(), n.tolist(), strict=True) for k in range(m)]
    assert windows(h, rows, start, n) == windows(whole[0], *whole[2:])
    assert len(set(f[(rows == 0) & (n == 15)].tolist())) == 1


def test_windows_of_all_hot_fragments_are_hashed_in_step(monkeypatch):
    import pyarrow as pa

    rng, mixed, mix = np.random.default_rng(3), [], repeats.mix
    texts = ["".join(rng.choice(list("abcd"), 300)) for _ in range(20)]
    runs = [[{"run": (s << repeats._RUN_BITS) | 3 + s % 5, "h": s, "hot": s % 9 != 0} for s in range(0, 280, 7)] for _ in texts]
    wanted = pa.array(runs, pa.list_(pa.struct([("run", pa.int64()), ("h", pa.int64()), ("hot", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 120), pa.int64()), pa.array(texts), wanted], names=["doc_id", "text", "wanted"])
    monkeypatch.setattr(repeats, "mix", lambda x: mixed.append(len(x)) or mix(x))
    unit = repeats.Unit(10, 4, words=False)
    got = sorted((r["h"], r["f"], r["doc_id"], r["run"], r["tokens"]) for b in repeats._contents(unit)(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist())
    assert len(mixed) <= 2 * (unit.window + 2)  # a batch, not a fragment, each
    want, u = [], np.uint64
    for doc, text, rs in zip(range(100, 120), texts, runs, strict=True):
        codes = repeats._BYTE_CODE[np.frombuffer(text.encode(), np.uint8)]
        for r in rs:
            start, n = r["run"] >> repeats._RUN_BITS, r["run"] & ((1 << repeats._RUN_BITS) - 1)
            if not r["hot"]:
                want.append((r["h"], 0, doc, r["run"], text[start : start + n + 9].encode()))
                continue
            for k in range(start, start + n):
                one = two = np.zeros(1, u)
                for j in range(10):
                    one = one + codes[k + j : k + j + 1] * u(pow(0x9E3779B97F4A7C15, j + 1, 2**64))
                    two = two + mix(codes[k + j : k + j + 1] + u(j))
                want.append((int(repeats.as_long(mix(one))[0]), int(repeats.as_long(mix(two))[0]), doc, (k << repeats._RUN_BITS) | 1, None))
    assert [r[:4] for r in got] == sorted(r[:4] for r in want) and {r for r in got if r[4]} == {r for r in want if r[4]}


def test_near_duplicates(docs, texts):
    sets = {}
    for doc, text in texts.items():
        w = WORDS.findall(text.translate(LOWER))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders, both, root = {}, Counter(), {d: d for d in texts}
    for doc in sorted(sets):
        for s in sets[doc]:
            for other in holders.setdefault(s, []):
                both[other, doc] += 1
            holders[s].append(doc)

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found == {d: (len(sets[d]), top(d), top(d) == d) for d in texts}


def test_left_over_pairs_meet_by_bitmap(spark, monkeypatch):
    """Edited copies of one text, near the threshold on both sides: what the hubs leave is decided as brute force does."""
    draw, base, rows = random.Random(7), [f"w{i}" for i in range(150)], []
    for doc in range(60):
        own = list(base)
        for place in draw.sample(range(150), draw.choice([2, 4, 6, 8])):
            own[place] = f"n{draw.randrange(10**6)}"
        rows.append((doc, " ".join(own)))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    lowest = {d: d for d in sets}
    while True:
        before = dict(lowest)
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        if before == lowest:
            break
    met, plain = [], minhash._bitmaps_of
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    monkeypatch.setattr(minhash, "_bitmaps_of", lambda *a: met.append(a) or plain(*a))
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert met and found == lowest and len(set(lowest.values())) > 1


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(rows) == order
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        cut = len(texts[a]) // 4
        edited = texts[a][: len(texts[a]) - cut] + texts[b][:cut]
        assert rows[a].n_chars == len(texts[a])
        assert rows[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[a].near_next <= 1 and 0 <= rows[a].near_edited <= 1
    by_text = {}
    for d in order:
        assert by_text.setdefault(texts[d], rows[d].fingerprint) == rows[d].fingerprint
    long = [d for d in order if len(texts[d]) > 1000 and d < 10_000]
    assert sum(rows[d].near_edited for d in long) / len(long) > 0.45
    assert sum(rows[d].near_next for d in long) / len(long) < 0.1


def test_parsing_is_local(spark):
    """A long shared part gives the same phrases at any offset."""
    import random

    random.seed(1)
    shared = "".join(random.choice("abcdefgh ") for _ in range(6000))
    a, b = fingerprint.fingerprints(["start " + shared, "another beginning, longer by far " + shared])
    assert (a == b).mean() > 0.9


def test_licenses(docs, texts):
    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for r in licenses.licenses(docs).collect():
        w = word.findall(texts[r.doc_id].translate(LOWER))
        starts = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in starts]
        labels = sorted({label for _, label in starts})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(("text", "accepted"), [("permit use always", True), ("permit any free use always", True), ("permit any use always", False), ("permit use of one two always", True), ("permit use of one two three always", False), ("permit use", False)])
def test_template_regions(text, accepted):
    made = licenses.compiled("x", "permit [[any free]] use [[of {2}]] always")
    assert (made.longest(text.split(), 0) == len(text.split())) is accepted


def test_packing(docs, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), chunk_tokens=20_000).collect()
    import zlib

    import numpy as np

    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0


def test_costs_are_balanced():
    sizes = [100 + 37 * i % 1500 for i in range(3000)]
    placed, cost = packing.place(sizes)
    full = cost[: sum(sizes) // 2048]
    assert max(full) < 1.6 * min(full)
    assert sum(n for _, _, n, _, _ in placed) == sum(sizes)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, texts, order):
    words = {d: WORDS.findall(t) for d, t in texts.items()}
    counts = Counter(tuple(w[i : i + n]) for w in words.values() for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words.values()))

    def log_s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        return math.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= 2 else math.log(0.4) + log_s(gram[1:])

    for r in lm_score.scores(docs, order=order, part_bytes=100_000, bucket_keys=5000).collect():
        w = words[r.doc_id]
        wanted = sum(log_s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))
        assert r.n_words == len(w) and r.log_score == pytest.approx(wanted, rel=1e-9, abs=1e-6)
        assert (r.mean_log_score is None) == (not w)


def test_leaks(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    planted = spark.createDataFrame([(20_000 + i, f"before it {t} and after") for i, t in items.items()] + [(30_000, None)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.select("doc_id", "text").union(planted), bench.union(bench)).collect()}
    clean = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    held = {(d, i) for d, t in texts.items() for i, x in items.items() if clean(x) in clean(t)} | {(20_000 + i, i) for i in items}
    assert held <= found
    in_slices = {(r.doc_id, r.item_id) for r in decontaminate.leaks(planted, bench, slice_words=100).collect()}
    assert in_slices == {p for p in found if p[0] >= 20_000}


def test_lm_default_order_sees_two_words_before(spark):
    """'c' after 'a b' (twice) and after 'x b' (twice, but always 'd'): only a trigram model tells them apart."""
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "x b d"), (4, "x b d")], "doc_id long, text string")
    found = {r.doc_id: r.log_score for r in lm_score.scores(rows).collect()}
    assert found == pytest.approx(dict.fromkeys((1, 2, 3, 4), math.log(2 / 12)))


def _brute_leaks(documents, items):
    """Best similarity of every pair over all places, from the threshold on."""
    shingles = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    weight = lambda s: sum(map(len, s))
    out = {}
    for i, words in items.items():
        own = shingles(words)
        for d, text in documents.items():
            likes = [weight(own & a) / weight(own | a) for p in range(max(1, len(text) - len(words) + 1)) for a in [shingles(text[p : p + len(words)])] if own & a]
            if likes and max(likes) >= 0.75:
                out[d, i] = max(likes)
    return out


def test_leaks_with_edits(spark):
    """One word replaced, left out or put in, at every place of short, middle and long items and at every offset in the document."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    items = {m: [word() for _ in range(m)] for m in (5, 6, 7, 9, 11, 12, 13, 14, 17, 24, 46, 47, 53, 60)}
    documents = {}
    for words in items.values():
        for p in range(len(words)):
            for n, middle in enumerate(([word()], [], [words[p], word()])):
                documents[len(documents)] = [word() for _ in range(20 + (p + n) % 4)] + words[:p] + middle + words[p + 1 :] + [word() for _ in range(20)]
    wanted = _brute_leaks(documents, items)
    assert {i for _, i in wanted} == set(items)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in documents.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()}
    assert found == pytest.approx(wanted)


def test_leaks_of_items_below_five_words(spark):
    """Items of 0 to 4 words, some inside others or equal, against every place of every document; one slice and many."""
    rng = random.Random(11)
    documents = {d: [rng.choice("abc") for _ in range(rng.randint(0, 12))] for d in range(60)} | {60: "please answer forty two now".split(), 61: ["x", "y"] * 20_000}
    items = {i: [rng.choice("abc") for _ in range(1 + i % 4)] for i in range(24)} | {30: "answer forty two".split(), 31: [], 32: ["y", "x"], 33: "forty two now please".split()}
    wanted = {}
    for i, words in items.items():
        for d, text in documents.items():
            places = [p for p in range(len(text) - len(words) + 1) if words and text[p : p + len(words)] == words]
            if places:
                wanted[d, i] = (places[0], 1.0)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in documents.items()] + [(70, None)], "doc_id long, text string").withColumn("m", F.lit("x")).withColumn("words", F.lit(1))
    bench = spark.createDataFrame([(i, ", ".join(w).upper()) for i, w in items.items()] + [(40, None)], "item_id long, text string")
    for slice_words in (200_000, 5):
        found = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.leaks(docs, bench, slice_words=slice_words).collect()}
        assert found == wanted
    assert (60, 30) in wanted


def test_rows_are_told_apart_by_id_and_text(spark):
    """Two texts under one id, and rows without an id: each is judged by its own text."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, f"so {passage} there", 1), (1, "quite another text", 2), (None, passage, 3), (None, "harmless", 4), (None, None, 5), (2, "", 6)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n int, leaking_id string, kept_id string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns and sorted(r.n for r in clean.collect()) == [2, 4, 5, 6]
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 6 and decontaminate.without_leaks(docs.limit(0), bench).count() == 0
    one = minhash.one_per_group(docs.union(docs))
    assert one.columns == docs.columns and sorted(r.n for r in one.collect()) == [1, 2, 3, 3, 4, 4, 5, 5, 6]


def test_empty_and_nameless(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    nameless = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None)], "doc_id long, text string")
    for fn in (suffix_dedup.repeated_bytes, substring_dedup.repeated_words, minhash.near_duplicates, fingerprint.edited_fingerprints, licenses.licenses, lm_score.scores):
        assert fn(none).count() == 0, fn
        assert fn(nameless).count() == 4, fn
    assert minhash.one_per_group(nameless).count() == 3
