"""What the removal of repeats leaves on the disks while it runs."""

import pytest

from callmeter.llm import suffix_dedup
from callmeter.runtime import Folder, shared_root


@pytest.mark.parametrize("hot", [1000, 1])
def test_tokens_of_fragments_are_gone_before_the_texts_are_read_again(spark, hot):
    words = [f"word{i % 7}-{i * 37 % 101}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 40])) for i in range(8)], "doc_id long, text string")
    folder = f"{shared_root(spark)}/callmeter/{spark.sparkContext.applicationId}"
    old = set(Folder(spark).children(folder))
    found = suffix_dedup.repeated_bytes(docs, hot=hot)
    kept = [n for n in Folder(spark).children(folder) if n not in old]
    assert kept and not any("tokens" in spark.read.parquet(f"{folder}/{n}").columns for n in kept)
    # What is left to do has one shuffle of texts, none of tokens.
    assert "tokens" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["n_removed"] > 0 for r in found.collect()} == {i: i > 0 for i in range(8)}
