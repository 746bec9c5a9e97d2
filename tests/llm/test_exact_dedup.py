"""The extendible-hash index against brute force: ties, nulls, copies, collisions, splits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from callmeter.llm import exact_dedup

LOWER = {i: i + 32 for i in range(65, 91)}
ROWS = (
    [(i, f"Text number {i % 37}" if i % 2 else f"text Number {i % 37}") for i in range(200)]
    + [(300, None), (301, ""), (302, "É"), (303, "é"), (304, "x" * 200_000), (305, "X" * 200_000), (None, "alone"), (None, "É"), (306, "twice"), (306, "twice"), (306, "other")]
    + [(1000 + i, "very common") for i in range(400)]
)


def brute(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(doc)
    out = []
    for norm, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def table(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumn("key", F.lit("x")).withColumn("norm", F.lit(1)).withColumn("bucket", F.lit(None).cast("string")).repartition(3)


@pytest.mark.parametrize("options", [{}, {"capacity": 4}, {"capacity": 4, "key_bits": 3}, {"key_bits": 1}])
def test_groups(spark, options):
    got = exact_dedup.exact_groups(table(spark, ROWS), **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []


def test_directory_doubles(spark):
    """Buckets stay within their capacity, every key has its slot, and chains are numbered."""
    index = exact_dedup.build(table(spark, ROWS), capacity=4)
    slots = index.directory.count()
    assert 2**index.depth > 16 and slots <= 2**index.depth and slots == index.directory.select("slot").distinct().count()
    held = {r.bucket: r["count"] for r in index.links.groupBy("bucket").count().collect()}
    assert max(held.values()) <= 4 and len(held) > 8
    depths = {r.depth for r in index.directory.select("depth").distinct().collect()}
    assert max(depths) == index.depth and len(depths) > 1
    chained = exact_dedup.build(table(spark, ROWS), key_bits=2).links
    assert chained.select("key").distinct().count() == 4
    for row in chained.groupBy("key").agg(F.collect_list("link").alias("links"), F.max("chained").alias("n")).collect():
        assert sorted(row.links) == list(range(1, row.n + 1))


def test_search_of_new_documents(spark):
    index = exact_dedup.build(table(spark, ROWS), capacity=8)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in index.find(table(spark, [(1, "VERY COMMON"), (2, "unheard of"), (3, None)])).collect()}
    assert got == {1: (1399, 400), 2: (None, None), 3: (301, 2)}
