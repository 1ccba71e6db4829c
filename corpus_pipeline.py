"""From raw documents to shards of a training mix, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between two
stages the rows are written as Parquet and read again, so each starts from files. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from somnotab.llm import contamination, language, mixing, shards, simhash, storage
from somnotab.sources.files import delete_folder

#: The field's words cannot be labelled in SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those of which no language has enough words."""
    return language.accepted(docs, language.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies stays: fingerprints that differ in two bits at most."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, until every source has its share of the words."""
    return mixing.sampled(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row has a shard."""
    return shards.placed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and the rows it read, are deleted once its rows are written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = storage.new_path(spark, name)
        with storage.scratch(spark, f"{name}-work"):
            docs = storage.staged(stage(spark, docs, sf_dir), name, path)
        if read is not None:
            delete_folder(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
