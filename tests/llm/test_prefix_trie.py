"""The conversation trie against brute force, over one shard and over many."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from callmeter.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, _digest(role, text), role, text))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    ends, members = {}, {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + t[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        childless = [q for q in under if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        children = sum(len(q) == len(p) + 1 for q in under)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, len(childless), saved, sha))
    return sorted(out, key=str)


def table(spark, rows):
    made = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("key", F.lit("k")).withColumn("depth", F.lit(None).cast("string"))
    return made.repartition(3)


def _made():
    rng = random.Random(5)
    rows = []
    for c in range(90):
        alike = c % 3 == 0  # a third begins alike
        for t in range(rng.randint(1, 12)):
            word = f"turn {t}" if alike and t < 9 else rng.choice(["yes", "no", "ÿes", "", None, f"own {c}"])
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 8 else "user", word))
    rows += [(200 + c, t, "user", f"copy {t}") for c in range(0, 60, 5) for t in range(4)]
    rows += [(c, None, None, None) for c in (301, 302)] + [(301, 1, "a", "bc"), (302, 1, "ab", "c"), (303, 2, "x", "tie"), (303, 2, "x", "ties"), (303, 2, "x", "tie")]
    rows += [(-7, 0, "user", "below"), (-5, 0, "user", "zero"), (None, 0, "user", "nobody's"), (400, 0, "user", "long " * 20_000)]
    return rows + [(404, t, "user", f"deep {t}") for t in range(700)]


@pytest.mark.parametrize("turns", [1 << 16, 60])
def test_nodes(spark, turns):
    rows = _made()
    got = prefix_trie.shared_prefixes(table(spark, rows), shard_turns=turns)
    assert got.columns == prefix_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_many_copies_in_one_node(spark):
    """Chunks of a long list of ends join to the hash of the whole list."""
    rows = [(5 * c, 0, "user", "same") for c in range(10_000)]
    got = {r.depth: r for r in prefix_trie.shared_prefixes(table(spark, rows)).collect()}
    assert got[0].n_convs == got[1].n_convs == 10_000
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(5 * c) for c in range(10_000)).encode()).hexdigest()
    assert got[1].saved_tokens == got[0].saved_tokens == 9_999 * 4


def test_empty_table(spark):
    assert prefix_trie.shared_prefixes(table(spark, [])).collect() == []


def test_siblings_are_balanced():
    """Paths that come in order make a tree of logarithmic height, not a list."""
    import numpy as np

    n = 4096
    ids = np.stack([np.arange(n), np.zeros(n, np.int64)], axis=1)
    made = []
    whole = prefix_trie.Tree._new

    def counted(self, *args):
        made.append(self)
        return whole(self, *args)

    prefix_trie.Tree._new = counted
    try:
        list(prefix_trie._nodes(0, np.arange(n), np.arange(n + 1), ids, np.ones(n, np.int64)))
    finally:
        prefix_trie.Tree._new = whole
    tree, height, layer = made[0], 0, [made[0].first[0]]
    while layer:
        height += 1
        layer = [j for i in layer for j in (tree.low[i], tree.high[i]) if j >= 0]
    assert height == 13
