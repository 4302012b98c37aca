"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, then the mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Every stage judges rows, not ids: null and repeated doc_ids are documents like others. Rows with a null or empty text go
with the first stage, as texts in no language; a very long text is one document in each stage; repeated rows are near
duplicates of each other, so one is left; of ties within a group the least id, then the least hash of the text stays.
Extra columns, whatever their names, are kept through all stages, but the last one's `copy` replaces a column of that
name, and n_chars is that of the masked text. An empty table, or one that a stage empties, gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from estate_jobs.llm import decontaminate, language_id, mixing, near_duplicates, secrets
from estate_jobs.llm.common import held_out, shared_folder, table

#: A text in no language, or with less than this share of its letters in its main one, is rejected.
MAIN_SHARE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one language: rejected are those without letters and those that no language covers half of."""
    model = language_id.learn(docs.filter(~held_out()))
    return language_id.keep(docs, model, MAIN_SHARE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near duplicates, that with the least doc_id; rows are told apart by id and text."""
    return near_duplicates.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars of the new text."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, with the number of the copy."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
]

#: Language models and MinHash have no form in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is kept in the shared checkpoint folder for the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
