"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
read as the next stage's ``docs``. All but the last return the columns of documents; the
last returns packed pieces.

Defined results: null texts stay null until packing, where they are the end id alone; they
and empty ones pass quality, hold no line that could go, are classes of their own and have
no benchmark words. Rows that repeat go through quality and line dedup each, then one of
each class of near-duplicates stays, the smallest doc_id's (null ids last, and of rows that
tie any one). Very long texts are worked whole and cut into pieces only by packing. More
columns pass through every stage but the last, whatever their names. Empty tables give no
rows; without labels all documents pass quality, without a benchmark all decontamination.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from priorflow.llm import decontam, line_dedup, near_dup, packing, resample, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    drawn = resample.resample(docs, labels)
    return drawn.filter(F.col(drawn.columns[-1])).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; lengths follow the text."""
    clean = line_dedup.dedup_lines(docs.withColumn("text_was_null", F.col("text").isNull()))
    dropped = F.col(clean.columns[-1])
    text = F.when(~F.col("text_was_null"), F.col("text"))
    length = F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).withColumn("text", text).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    pieces = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=1024)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.col("payload").alias("ids"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Resampling, consistent sampling and packing aren't SQL; tests compare each stage's brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch.passing(spark):
            made = stage(spark, docs, sf_dir)
            docs = scratch.keep(made, f"stage-{name}", scratch.new_path(spark, f"stage-{name}", stays=True))
    return docs
