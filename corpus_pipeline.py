"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's docs.

Defined results, besides those of each stage's operator: rows without text or letters go in the first stage, whatever
their other columns; null or repeated ids and nulls in other columns stay as they are; of rows that are alike one stays
(the smallest id, null last, then as read); an empty table, or one that a stage empties, gives no rows; extra columns, of
any name, are carried up to the last stage, which returns doc_id, size, source_size, target and taken. Texts of any length
are worked on whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gondola.llm import chosenpath, decontaminate, langid, mixing, quality
from gondola.llm.common import deleted, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return langid.keep(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject stay."""
    return quality.keep(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return chosenpath.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document left."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
]

#: Learned models and windows of fingerprints have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written is deleted as soon as the next one's result no longer reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            deleted(spark, f"{folder}/{STAGES[k - 1][0]}")
    mixed_rows = STAGES[-1][1](spark, docs, sf_dir)  # reads its own table of sizes, not the texts
    deleted(spark, folder)
    return mixed_rows
