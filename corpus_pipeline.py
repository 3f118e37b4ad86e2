"""From raw documents to a training mix, in five stages; each gets the documents that the one before it kept.

All stages take nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any names; what
they make of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, langid, mixing, neardup, secrets
from strandloom.llm.common import materialize

#: Mean probability that a language must reach over a text; short clean texts reach 0.5 easily, noise doesn't.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language: not 'und', and not undecided between languages.

    Null texts and those without letters go. Every one of repeated rows stays or goes; long texts are read whole.
    """
    return langid.in_known_language(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id.

    Of repeated rows one stays. Null and blank texts resemble nothing and stay; a null doc_id counts as the largest.
    """
    return neardup.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passage of a benchmark item.

    Null and empty texts and items match nothing; every one of repeated rows stays or goes.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets (of any layer) replaced in the text; n_chars follows the text.

    Null texts stay null, repeated rows stay repeated.
    """
    return secrets.redact_documents(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in random order, with the number of the copy.

    A null source is a source of its own; rows that share a doc_id share the count.
    """
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("without_secrets", without_secrets),
    ("mixed", mixed),
]

#: Language ID and the LSH forest can't be expressed in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
