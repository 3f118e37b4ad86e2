"""The queries of the text operators over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, langid, lm, mixing, neardup, quality, resampling, secrets, substrings, token_counts, toxicity, warc
from .common import materialize, scratch

VOCABULARY = os.environ.get("STRANDLOOM_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
BYTE_LEVEL = os.environ.get("STRANDLOOM_BYTE_LEVEL", "/opt/tokenizers/byte_bpe_50k.json")
PIECES = os.environ.get("STRANDLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive is written, read back into its two stores and rebuilt; sizes and digests are those of the joined payloads."""
    path = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    headers = materialize(warc.header_store(warc.read_archive(spark, path, payloads=False)), "headers")
    full = warc.reconstruct(headers, warc.payload_store(warc.read_archive(spark, path)))
    digest = warc.base32_sha1(F.col("payload"))
    checked = F.when(digest == F.col("payload_digest"), digest).otherwise(F.raise_error(F.lit("a payload's digest does not hold")))
    size = F.when(F.col("record").isNotNull(), F.octet_length("payload").cast("bigint"))
    return full.select(F.col("id").alias("page_id"), size.alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages removed; the digest of what is left."""
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc, op2_language, op3_secrets, op4_toxicity, op5_jaccard, op6_hmm, op7_decontaminate, op8_quality, op9_tokens, op10_mix, op11_substrings, op12_resampling, op13_alignment)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.ORACLE, "op5_jaccard": neardup.ORACLE, "op10_mix": mixing.oracle(), "op11_substrings": substrings.ORACLE, "op12_resampling": resampling.ORACLE}
