"""Tables that many queries start from, derived from the stored graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import key_hash
from ..lineage import materialize
from ..operators.graph import collect_holdout_pairs, pair_relations, remove_direct_edges
from ..operators.paths import connected_pairs, gene_links, pair_triplets
from ..operators.splits import make_split
from .graph_store import graph
from .oracle import SEED

FRACTIONS = {"train": 0.7, "valid": 0.1, "test": 0.1, "ot": 0.1}

_tables: dict[tuple[str, str, str], DataFrame] = {}
_links: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialize(build(), name)
    return _tables[key]


def splits(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """(split, drug, disease) of one mode, written once like a split asset."""
    def build() -> DataFrame:
        return make_split(pair_relations(graph(spark, sf_dir).edges), mode, FRACTIONS, SEED).select(
            "split", "drug", "disease"
        )

    return _stored(spark, sf_dir, f"split_{mode}", build)


def triplets(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """(split, drug, gene, disease) mechanisms of the pairs of one split mode."""
    def build() -> DataFrame:
        return pair_triplets(graph(spark, sf_dir).edges, splits(spark, sf_dir, mode))

    return _stored(spark, sf_dir, f"triplets_{mode}", build)


def links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(drug, gene) and (disease, gene), written once for all that looks for genes of drugs and diseases."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _links:
        _links[key] = gene_links(graph(spark, sf_dir).edges)
    return _links[key]


def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drug, disease) joined by a gene, written once as the index that sampling and ranking share."""
    def build() -> DataFrame:
        return connected_pairs(graph(spark, sf_dir).edges, links=links(spark, sf_dir))

    return _stored(spark, sf_dir, "connected", build)


def clean_edges(spark: SparkSession, sf_dir: str, mode: str = "cross_disease") -> DataFrame:
    """Edges without the direct links of held-out pairs."""
    held = collect_holdout_pairs(splits(spark, sf_dir, mode))
    return remove_direct_edges(graph(spark, sf_dir).edges, held)


def pseudo_score(*cols: str) -> Column:
    """Deterministic score with many ties, between -2 and 2."""
    return F.pmod(key_hash("score", *cols), F.lit(1000)).cast("double") / F.lit(250.0) - F.lit(2.0)


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drug, disease, score, label): connected pairs and clinical pairs, the latter positive."""
    edges = graph(spark, sf_dir).edges
    clinical = pair_relations(edges).select("drug", "disease", F.lit(1).alias("label"))
    linked = connected(spark, sf_dir).withColumn("label", F.lit(0))
    both = linked.unionByName(clinical).groupBy("drug", "disease").agg(F.max("label").alias("label"))
    return both.select("drug", "disease", pseudo_score("drug", "disease").alias("score"), "label")
