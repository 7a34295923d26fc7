"""One query per operator, over its whole table and with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit, bisectors, jaccard_join, language_id, line_dedup, mixing, passages, periodic_runs, quality, spot_signatures, token_counts,
    url_rules, vantage_trees,
)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    judged = quality.judge_quality(docs, quality.language_references(docs))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )


@_query
def op2_passage_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))[0]


@_query
def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprint_documents(documents(spark, sf_dir))


@_query
def op4_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    folded = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    profiles = language_id.learn_profiles(folded.filter(~F.col("held_out")))
    return language_id.identify_languages(folded.select("doc_id", "held_out", "text"), profiles).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


@_query
def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source")
    return mixing.mix_sources(docs)


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(
        spark, documents(spark, sf_dir),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


@_query
def op9_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source is its site."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source")


@_query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through the document of the same id: toxic or of low quality means block."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.max(((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0))).alias("blocked")
    )
    labelled = pages.join(bad, F.col("page_id") == F.col("_doc")).select(url_rules.url_tokens(F.col("url")).alias("tokens"), "blocked")
    return url_rules.judge_urls(pages, *url_rules.mine_rules(labelled)).drop("url")


@_query
def op11_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.clusters_with_inertia(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@_query
def op12_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_trees.simhash_components(documents(spark, sf_dir).select("doc_id", "text"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document, by its id, is made periodic before runs are sought."""
    return periodic_runs.find_runs(documents(spark, sf_dir).select("doc_id", "text"), repeat=True, texts=False)
