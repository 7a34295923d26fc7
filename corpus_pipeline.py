"""Documents to packed training sequences: quality, lines, near copies, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.lineage import materialize
from pathloom.llm import best_fit, jaccard_join, line_dedup, mixing, quality

# Part of the target weights: 1 keeps the sources' own shares, 0 makes all equal.
TEMPER = 0.9


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the basic rules and lie near their language's histograms."""
    judged = quality.judge_quality(docs, quality.language_references(docs))
    return judged.filter("kept").select(*docs.columns)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; ``n_chars`` follows the text."""
    cut = line_dedup.drop_boilerplate(docs, "source")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard_join.drop_near_copies(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the shares of the target weights; small sources repeat, in mixed order."""
    return mixing.mixed_documents(docs, temper=TEMPER).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return best_fit.pack_documents(
        spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_frequency),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packing),
]

# Tokenisation and similarity components cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
