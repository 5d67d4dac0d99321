"""Corpus pipeline: language, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import language, near_dup, packing, secret_scan, suffix
from quantloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the language network rejects: without letters (null and empty texts too), or far more likely text of no known language."""
    net = language.train(docs)
    return language.keep_recognised(docs, net).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id (five-word shingles, similarity 0.8)."""
    return near_dup.first_of_each(docs, shingle=5, percent=80).select(*COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated passages from texts, keeping their first place; a text of which nothing is left goes."""
    out = suffix.remove_repeats(docs)
    whole = out.select("doc_id", F.col("kept").alias("text"), F.col("other.lang").alias("lang"), F.col("other.source").alias("source"), "n_removed")
    left = whole.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret, weak ones too where linked; documents stay."""
    return secret_scan.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids along the curve, a row per piece."""
    import public_tokenizers

    packed = packing.pack_by_curve(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.drop("ids", "curve_key")


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("suffix_dedup", suffix_stage), ("secrets", secret_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None
