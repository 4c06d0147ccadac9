"""Corpus pipeline: five stages over ``documents``, each written and read again.

Toxic documents go, repeated lines go, one document of each group of near copies
stays, contaminated documents go, and what is left is mixed by source. A stage works
on all that the one before kept. SQL cannot express the first stage (a trained
tagger), so there is no statement for the whole; tests compare the stages with plain
versions.

Nulls, empty and repeated rows, and empty tables are handled as each operator says;
columns that ``documents`` has beside its own are handed on by all stages but the
last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinimart.llm import decontamination, line_dedup, mixing, simhash, toxicity
from clinimart.sources.storage import written_once


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.report(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written_once(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
