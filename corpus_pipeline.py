"""Stages that turn the documents table into packed training sequences.

Each stage takes (spark, docs, sf_dir) and reads all that the one before it kept; all but the last return the columns of
documents. SQL can express none of the models and joins here, so tests/llm/test_pipeline.py holds the stages against
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import decontam, jaccard, langid, lines, packing
from talus.llm.store import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letters (null and empty text too) or whose language no class explains with a calibrated score of one half.

    Learns from the rows that the stage is given, as op4 does; without any to learn from, all go. A null doc_id counts as empty.
    """
    return langid.known_language(docs).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and near copies of earlier lines go; so do documents that lose every line by it. n_chars follows the text.

    Earlier is by doc_id, null first, rows that share one by hash of text; repeated rows lose all lines but the first's.
    """
    out = lines.dedup(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike("\\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id (null first, then by hash of text) stays; so do all without words."""
    return jaccard.first_of_groups(docs).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and an empty benchmark takes none."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens; null and empty texts are the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages; see above.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table. Each stage takes an empty table and gives one; extra columns are left out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
