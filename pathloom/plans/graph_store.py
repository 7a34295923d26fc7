"""The knowledge graph derived from the relational tables, stored once per session.

Nodes: suppliers are drugs, parts genes, customers diseases, brands and part
types pathways. Every order line is one edge, and its values say of which kind: untaxed ones are clinical links of
supplier and customer, of the others those of little discount link customer and part, and the rest supplier and part. Parts up
to size 40 are in their brand's pathway, up to 20 in their type's too; larger
ones interact with the part before them. The store is Parquet in the shared
folder, laid out by edge type, so every consumer prunes to the types it reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import materialize
from ..operators.graph import EDGE_TYPE
from ..operators.identity import assign_ids, build_edge_table
from ..schema import DISEASE, DRUG, GENE, PATHWAY


class Graph:
    """Stored nodes, and edges that are stored when they are first asked for."""

    def __init__(self, nodes: DataFrame, build_edges: Callable[[DataFrame], DataFrame]):
        self.nodes, self._build_edges = nodes, build_edges

    @cached_property
    def edges(self) -> DataFrame:
        return self._build_edges(self.nodes)


_stores: dict[tuple[str, str], Graph] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with the columns their global order follows: type, number, text."""
    def typed(df: DataFrame, rank: int, node_type: str, num, text, name, source: str) -> DataFrame:
        key = F.coalesce(num.cast("string"), text)
        return df.select(
            F.lit(rank).alias("type_rank"),
            num.cast("bigint").alias("num"),
            text.alias("txt"),
            F.concat(F.lit(f"{node_type}::"), key).alias("raw_id"),
            F.lit(node_type).alias("node_type"),
            name.alias("name"),
            F.lit(source).alias("source"),
        )

    none = F.lit(None).cast("string")
    part = table(spark, sf_dir, "part")
    pathways = part.select(F.explode(F.array("p_brand", "p_type")).alias("pathway")).distinct()
    return (
        typed(table(spark, sf_dir, "supplier"), 0, DRUG, F.col("s_suppkey"), none, F.col("s_name"), "DrugBank")
        .unionByName(typed(part, 1, GENE, F.col("p_partkey"), none, F.col("p_name"), "NCBI"))
        .unionByName(typed(pathways, 2, PATHWAY, F.lit(None), F.col("pathway"), F.col("pathway"), "REACTOME"))
        .unionByName(typed(table(spark, sf_dir, "customer"), 3, DISEASE, F.col("c_custkey"), none, F.col("c_name"), "MONDO"))
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by raw id."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part")

    def edge(df: DataFrame, src_type: str, src, rel, dst_type: str, dst) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{src_type}::"), src.cast("string")).alias("src_id"),
            F.lit(src_type).alias("src_type"),
            rel.alias("rel"),
            F.lit(dst_type).alias("dst_type"),
            F.concat(F.lit(f"{dst_type}::"), dst.cast("string")).alias("dst_id"),
        )

    targets = line.filter("l_tax <> 0 and l_discount > 0.01").select("l_suppkey", "l_partkey").distinct()
    placed = line.filter("l_tax = 0 or l_discount <= 0.01").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    associated = placed.filter("l_tax <> 0").select("o_custkey", "l_partkey").distinct()
    clinical = placed.filter("l_tax = 0").select("l_suppkey", "o_custkey", "l_returnflag").distinct()
    relation = (
        F.when(F.col("l_returnflag") == "A", "indication")
        .when(F.col("l_returnflag") == "R", "off-label use")
        .otherwise("contraindication")
    )
    brands = part.filter("p_size <= 40").select("p_partkey", F.col("p_brand").alias("pathway"))
    kinds = part.filter("p_size <= 20").select("p_partkey", F.col("p_type").alias("pathway"))
    in_pathway = brands.unionByName(kinds).distinct()
    large = part.filter("p_size > 40 and p_partkey > 1").select("p_partkey")
    return (
        edge(targets, DRUG, F.col("l_suppkey"), F.lit("targets"), GENE, F.col("l_partkey"))
        .unionByName(edge(associated, DISEASE, F.col("o_custkey"), F.lit("disease_protein"), GENE, F.col("l_partkey")))
        .unionByName(edge(in_pathway, GENE, F.col("p_partkey"), F.lit("in_pathway"), PATHWAY, F.col("pathway")))
        .unionByName(edge(clinical, DRUG, F.col("l_suppkey"), relation, DISEASE, F.col("o_custkey")))
        .unionByName(edge(large, GENE, F.col("p_partkey"), F.lit("protein_protein"), GENE, F.col("p_partkey") - 1))
    )


def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with ids from 1, so that the dummy pathway id 0 is no node."""
    order = ["type_rank", "num", "txt"]
    return assign_ids(raw_nodes(spark, sf_dir), order, start=1).select(
        "global_id", "local_id", "raw_id", "node_type", "name", "source"
    )


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The stored graph of ``sf_dir``, built on first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        def build_edges(nodes: DataFrame) -> DataFrame:
            edges = materialize(build_edge_table(nodes, raw_edges(spark, sf_dir)), "edges", EDGE_TYPE)
            return edges.select("src_id", "src_type", "rel", "dst_type", "dst_id")

        _stores[key] = Graph(materialize(build_nodes(spark, sf_dir), "nodes"), build_edges)
    return _stores[key]
