"""From raw documents to packed sequences: toxicity, near duplicates, benchmark leaks, personal data, packing.

``STAGES`` are (name, function) pairs; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmeter.llm import decontaminate, minhash, packing, surrogates, toxicity
from callmeter.llm.text import documents
from callmeter.runtime import written

#: No SQL twin: a fitted model, MinHash and a tokenizer are not SQL; see tests/llm/.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of high expected severity. The model is fitted on the whole table's labelled rows."""
    model = toxicity.fit_severity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_per_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes surrogates and counts characters anew where a text changed."""
    done = surrogates.replaced(docs)
    return done.withColumn("n_chars", F.when(F.col("n_private") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("decontamination", drop_leaks), ("private_data", hide_private), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
