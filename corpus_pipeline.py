"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. The number of rows, nulls, repeated rows and
extra columns may be anything the operators define (see their docstrings); extra columns pass through the stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontaminate, language_id, mixing, simhash
from cohortlens.llm.queries import MIX_WEIGHTS, fitted_language_model
from cohortlens.session import ensure_checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the language model rejects go; it is fitted on the labelled rows of ``docs``."""
    return language_id.predict(docs, fitted_language_model(docs)).where("NOT rejected").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs, words=4, bits=4)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark, window=10).where("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document that it takes words from, with its size, its source's target, and taken."""
    return mixing.mix(docs, MIX_WEIGHTS).where("taken > 0").select(
        "doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", identify_language), ("simhash_near_dedup", drop_near_copies),
          ("decontamination", decontaminated), ("mixing", mixed)]

#: The fitted language model and the XXH64 fingerprints have no DuckDB SQL; tests/llm hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
