"""A corpus pipeline: quality, near-duplicates, decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns of
documents. run() applies them in order, each result written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, mixing, quality, sharding, simhash
from graphloom.llm.common import documents, materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null and empty texts are judged as empty ones; null ids, ties and repeated rows are judged by their text alone; with
    nothing to learn from, or an empty table, what comes in goes out.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id; rows without an id come last.

    Null and empty texts form one group. An id that stands in several groups keeps a row in each; of rows equal in id and
    text one stays, whatever their other columns. An empty table gives an empty one.
    """
    return simhash.deduplicate(docs, null_ids_stay=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark, however long they are.

    Null and empty texts hold none and stay; null ids and repeated rows are judged by their text alone; an empty benchmark
    drops nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources repeated up to the limit.

    Null sources are one source; a source without words (null and empty texts) is used once; equal rows are used alike.
    """
    return mixing.mix(docs, max_repeats=mixing.MAX_REPEATS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shuffled order with their shard and slot; columns of these names are replaced.

    Null texts and ids and repeated rows are records like any other; an empty table gives an empty one.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hashes, fingerprints and fitted models are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
