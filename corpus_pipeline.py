"""A training-corpus pipeline of five stages over `documents`, each a call of one operator.

Defined cases, for every stage: ids may be null or repeat, and decide nothing but which of several copies stays; columns
of any name and kind go along as they are; rows equal in all columns are interchangeable; null and empty texts have no language,
so the first stage drops them, and a stage that meets them treats them as one text; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from perfloom.llm import decontaminate, langid, mixing, sharding, simhash
from perfloom.llm.common import remove, shared_folder

#: Languages that are kept: every learnt one; rejected are texts without a letter, and those that
#: are less likely under the best mixture than under even odds for all trigrams.
EVEN_ODDS = -11.09


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no language: a row is judged by its own text, whatever its id."""
    return langid.spoken(docs, EVEN_ODDS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that hang together by a Jaccard similarity of 0.8 of five-word shingles: the one with the smallest id, those without an id last."""
    return simhash.without_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a test item: a row is judged by its own text, whatever its id."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole, in training order."""
    return mixing.mix(docs, whole=True)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]

#: SQL can't express the stages that learn or hash; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # each stage's rows are written to the shared folder and read again, so that no stage runs twice
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # the stage before is read no more; the last one's rows are the result and stay
            remove(spark, f"{folder}/{k - 1}")
    return docs
