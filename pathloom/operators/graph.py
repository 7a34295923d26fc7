"""Edge tables: orientation, leakage-free cleaning, masking and before/after reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import classify_edge_type, is_direct_relation, joins_types, normalize_relation, orient_pair
from ..functions.numeric import safe_ratio
from ..schema import DIRECT_RELATIONS, DISEASE, DRUG, GENE, PATHWAY

EDGE_TYPE = ("src_type", "rel", "dst_type")


def drug_gene(edges: DataFrame) -> DataFrame:
    """Distinct (drug, gene) over every relation and direction."""
    return orient_pair(edges, DRUG, GENE, ("drug", "gene")).select("drug", "gene").distinct()


def disease_gene(edges: DataFrame) -> DataFrame:
    return orient_pair(edges, DISEASE, GENE, ("disease", "gene")).select("disease", "gene").distinct()


def gene_pathways(edges: DataFrame, relations: Sequence[str] | None = None) -> DataFrame:
    kept = edges.filter(F.col("rel").isin(*relations)) if relations else edges
    return orient_pair(kept, GENE, PATHWAY, ("gene", "pathway")).select("gene", "pathway").distinct()


def direct_pairs(edges: DataFrame, variant: str = "plain", relations: Sequence[str] = DIRECT_RELATIONS) -> DataFrame:
    """(drug, disease, rel) of clinical links, the relation without its affixes."""
    oriented = orient_pair(edges.filter(is_direct_relation(relations, variant)), DRUG, DISEASE, ("drug", "disease"))
    return oriented.withColumn("rel", normalize_relation("rel", variant))


def pair_relations(edges: DataFrame, relations: Sequence[str] = DIRECT_RELATIONS) -> DataFrame:
    """Distinct target pairs with their sorted relation names (at most one per relation)."""
    return (
        direct_pairs(edges, relations=relations)
        .groupBy("drug", "disease")
        .agg(F.sort_array(F.collect_set("rel")).alias("relations"))
    )


def _oriented_key(left: str, right: str) -> list:
    forward = F.col("src_type") == left
    return [
        F.when(forward, F.col("src_id")).otherwise(F.col("dst_id")),
        F.when(forward, F.col("dst_id")).otherwise(F.col("src_id")),
    ]


def remove_direct_edges(
    edges: DataFrame,
    holdout_pairs: DataFrame,
    edge_types: Sequence[tuple[str, str, str]] | None = None,
    variant: str = "plain",
) -> DataFrame:
    """Drop clinical drug-disease edges, in either direction, of held-out pairs.

    Edges of every other kind never reach the join.
    """
    direct = is_direct_relation(variant=variant, edge_types=edge_types)
    drug, disease = _oriented_key(DRUG, DISEASE)
    kept = (
        edges.filter(direct)
        .withColumns({"drug": drug, "disease": disease})
        .join(holdout_pairs.select("drug", "disease"), ["drug", "disease"], "left_anti")
        .select(*edges.columns)
    )
    return edges.filter(~direct).unionByName(kept)


def path_edge_keys(target_paths: DataFrame) -> DataFrame:
    """(kind, a, b) edges that the target paths run over.

    A triplet names no pathway, so it forbids its gene's whole ``gene_any`` key.
    """
    def key(kind: str, a: str, b: str | None):
        second = F.col(b) if b else F.lit(None).cast("bigint")
        return F.struct(F.lit(kind).alias("kind"), F.col(a).alias("a"), second.alias("b"))

    keys = [key("drug_gene", "drug", "gene"), key("disease_gene", "disease", "gene"), key("drug_disease", "drug", "disease")]
    if "pathway" in target_paths.columns:
        keys.append(key("gene_pathway", "gene", "pathway"))
    else:
        keys.append(key("gene_any", "gene", None))
    return target_paths.select(F.inline(F.array(*keys))).distinct()


def remove_path_edges(edges: DataFrame, target_paths: DataFrame, isolate: DataFrame | None = None) -> DataFrame:
    """Drop the edges, of any relation and direction, that target paths use.

    Quads forbid their own gene-pathway edge, triplets every pathway edge of
    their gene. ``isolate(node_type, node_id)`` also loses all its edges.
    """
    quad = "pathway" in target_paths.columns
    specs = [("drug_gene", DRUG, GENE), ("disease_gene", DISEASE, GENE), ("drug_disease", DRUG, DISEASE)]
    specs.append(("gene_pathway" if quad else "gene_any", GENE, PATHWAY))
    kind, a, b = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    for name, left, right in specs:
        match = joins_types(left, right)
        first, second = _oriented_key(left, right)
        kind = F.when(match, F.lit(name)).otherwise(kind)
        a = F.when(match, first).otherwise(a)
        b = F.when(match, F.lit(None).cast("bigint") if name == "gene_any" else second).otherwise(b)
    keyed = edges.withColumns({"_kind": kind, "_a": a, "_b": F.coalesce(b, F.lit(-1))})
    forbidden = path_edge_keys(target_paths).select(
        F.col("kind").alias("_kind"), F.col("a").alias("_a"), F.coalesce("b", F.lit(-1)).alias("_b")
    )
    touched = keyed.filter("_kind is not null").join(forbidden, ["_kind", "_a", "_b"], "left_anti")
    out = keyed.filter("_kind is null").unionByName(touched).select(*edges.columns)
    return isolate_nodes(out, isolate) if isolate is not None else out


def isolate_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop every edge that touches one of the (node_type, node_id) rows."""
    src = nodes.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src_id"))
    dst = nodes.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst_id"))
    return (
        edges.join(src, ["src_type", "src_id"], "left_anti")
        .join(dst, ["dst_type", "dst_id"], "left_anti")
        .select(*edges.columns)
    )


def isolation_targets(mode: str, splits: DataFrame) -> DataFrame:
    """Held-out (valid and test) entities of an entity-level split mode."""
    held = splits.filter(F.col("split").isin("valid", "test"))
    if mode == "cross_drug":
        return held.select(F.lit(DRUG).alias("node_type"), F.col("drug").alias("node_id")).distinct()
    if mode == "cross_disease":
        return held.select(F.lit(DISEASE).alias("node_type"), F.col("disease").alias("node_id")).distinct()
    return held.limit(0).select(F.lit("").alias("node_type"), F.col("drug").alias("node_id"))


def collect_holdout_pairs(
    splits: DataFrame, names: Sequence[str] = ("valid", "test", "ot"), paths: DataFrame | None = None
) -> DataFrame:
    """Distinct pairs of the chosen splits and of held-out paths."""
    pairs = splits.filter(F.col("split").isin(*names)).select("drug", "disease")
    if paths is not None:
        pairs = pairs.unionByName(paths.select("drug", "disease"))
    return pairs.distinct()


def masked_batch_edges(edges: DataFrame, batches: DataFrame) -> DataFrame:
    """(batch_id, edge) hidden while a training batch predicts its own positives.

    ``batches`` has ``batch_id``, ``drug``, ``disease``. The graph seen by a
    batch is the edge table minus its rows here; it is never copied per batch.
    """
    direct = edges.filter(is_direct_relation(variant="batch"))
    drug, disease = _oriented_key(DRUG, DISEASE)
    keyed = direct.withColumns({"drug": drug, "disease": disease})
    pairs = batches.select("batch_id", "drug", "disease").distinct()
    return keyed.join(pairs, ["drug", "disease"]).select("batch_id", *edges.columns)


def batch_graph(edges: DataFrame, batches: DataFrame, batch_id) -> DataFrame:
    """Edge table seen by one training batch."""
    own = batches.filter(F.col("batch_id") == F.lit(batch_id))
    direct = is_direct_relation(variant="batch")
    drug, disease = _oriented_key(DRUG, DISEASE)
    kept = (
        edges.filter(direct)
        .withColumns({"drug": drug, "disease": disease})
        .join(own.select("drug", "disease"), ["drug", "disease"], "left_anti")
        .select(*edges.columns)
    )
    return edges.filter(~direct).unionByName(kept)


def edge_counts_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*EDGE_TYPE).agg(F.count("*").alias("n_edges"))


def node_counts_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(
        F.count("*").alias("n_nodes"), F.max("global_id").alias("max_global_id"), F.max("local_id").alias("max_local_id")
    )


def deletion_report(raw: DataFrame, clean: DataFrame, only_deleted: bool = True) -> DataFrame:
    """Edges before, after and deleted per edge type, with a category.

    One pass: both tables are tagged and counted together.
    """
    tagged = raw.select(*EDGE_TYPE, F.lit(1).alias("_raw")).unionByName(
        clean.select(*EDGE_TYPE, F.lit(0).alias("_raw"))
    )
    counts = tagged.groupBy(*EDGE_TYPE).agg(
        F.sum("_raw").cast("bigint").alias("n_before"), F.sum(1 - F.col("_raw")).cast("bigint").alias("n_after")
    )
    report = counts.select(
        *EDGE_TYPE,
        classify_edge_type().alias("category"),
        "n_before",
        "n_after",
        (F.col("n_before") - F.col("n_after")).alias("n_deleted"),
        safe_ratio(F.col("n_before") - F.col("n_after"), F.col("n_before")).alias("deleted_ratio"),
    )
    return report.filter("n_deleted > 0") if only_deleted else report


def order_deletions(report: DataFrame) -> DataFrame:
    return report.orderBy("category", F.desc("n_deleted"), *EDGE_TYPE)


def deletion_totals(report: DataFrame) -> DataFrame:
    """Deleted edges by category, and in total under a null category."""
    return report.rollup("category").agg(F.sum("n_deleted").alias("n_deleted"), F.sum("n_before").alias("n_before"))
