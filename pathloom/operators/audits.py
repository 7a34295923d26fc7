"""Leakage, contamination and sampling audits; each returns what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import edge_type_label, joins_types, normalize_relation, orient_pair
from ..functions.numeric import safe_ratio
from ..functions.text import text_preview
from ..lineage import materialize
from ..schema import DIRECT_RELATIONS, DISEASE, DRUG, GENE, PATHWAY
from .phrases import in_slices
from .topology import incidences

# --- fixed values: leftover edge kinds as (kind, source type, source id, target type, target id) ---
RESIDUAL_KINDS = (
    ("reverse_gene_to_drug", GENE, "gene", DRUG, "drug"),
    ("reverse_pathway_to_gene", PATHWAY, "pathway", GENE, "gene"),
    ("reverse_disease_to_gene", DISEASE, "disease", GENE, "gene"),
    ("reverse_disease_to_pathway", DISEASE, "disease", PATHWAY, "pathway"),
    ("shortcut_drug_to_disease", DRUG, "drug", DISEASE, "disease"),
    ("shortcut_disease_to_drug", DISEASE, "disease", DRUG, "drug"),
)
# --- end of fixed values ---


def residual_edges(edges: DataFrame, quads: DataFrame) -> DataFrame:
    """Edges that still betray a held-out quad, one row per (kind, edge type, quad)."""
    cells = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(st).alias("src_type"),
            F.col(s).alias("src_id"),
            F.lit(dt).alias("dst_type"),
            F.col(d).alias("dst_id"),
        )
        for kind, st, s, dt, d in RESIDUAL_KINDS
    ]
    quad = ["drug", "gene", "pathway", "disease"]
    asked = quads.select(*quad, F.inline(F.array(*cells)))
    keys = ["src_type", "src_id", "dst_type", "dst_id"]
    return asked.join(edges.select(*keys, "rel").distinct(), keys).select(
        "kind", edge_type_label().alias("edge_type"), *quad
    )


def residual_summary(edges: DataFrame, quads: DataFrame) -> DataFrame:
    return residual_edges(edges, quads).groupBy("kind", "edge_type").agg(
        F.count("*").alias("n_hits"), F.count_distinct("drug", "gene", "pathway", "disease").alias("n_quads")
    )


def text_contamination(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs where one end's text contains the other end's name, ignoring case.

    ``texts`` has ``global_id``, ``name`` and ``text``. The names of an entity's
    partners go to its text in lists of bounded length, so a text is read once a list and
    never copied to a pair; what is found goes back to the pairs.
    """
    def ends(text_end: str, name_end: str) -> Column:
        direction = f"{text_end}_text_contains_{name_end}_name"
        return F.struct(F.lit(direction).alias("direction"), F.col(text_end).alias("_text_id"), F.col(name_end).alias("_name_id"))

    asked = pairs.select("drug", "disease", F.inline(F.array(ends("drug", "disease"), ends("disease", "drug"))))
    name = F.trim(F.coalesce("name", F.lit("")))
    names = materialize(texts.select(F.col("global_id").alias("_name_id"), name.alias("_name")).filter("_name <> ''"), "names")
    # a pair counts if both its ends have a name
    named = asked.select("_text_id", "_name_id").distinct().join(names, "_name_id").join(
        names.select(F.col("_name_id").alias("_text_id")), "_text_id", "left_semi"
    )
    listed = in_slices(materialize(named.select("_text_id", F.struct("_name_id", "_name").alias("item")), "named"), "_text_id", "item")
    read = texts.select("global_id", F.coalesce("text", F.lit("")).alias("_text")).join(listed, F.col("global_id") == F.col("_text_id"))
    held = F.filter("items", lambda x: F.contains(F.lower("_text"), F.lower(x["_name"])))
    hits = read.select("_text_id", text_preview("_text").alias("preview"), F.inline(held)).withColumnRenamed("_name", "matched")
    return asked.join(hits, ["_text_id", "_name_id"]).select("drug", "disease", "direction", "matched", "preview")


def contamination_summary(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    hits = text_contamination(pairs, texts).select("drug", "disease", "direction").distinct()
    n_pairs = pairs.select(F.count("*").alias("n")).scalar()
    return hits.agg(F.count("*").alias("n_leaks")).select(
        n_pairs.alias("n_pairs"),
        (n_pairs * 2).alias("n_checks"),
        "n_leaks",
        safe_ratio(F.col("n_leaks"), n_pairs * 2).alias("contamination_ratio"),
    )


def direct_shadow_hits(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Held-out pairs still linked, by edge type; ``direct`` when the relation is clinical."""
    links = edges.filter(joins_types(DRUG, DISEASE)).withColumn("edge_type", edge_type_label())
    forward = F.col("src_type") == DRUG
    oriented = links.select(
        "edge_type",
        F.col("rel").isin(*DIRECT_RELATIONS).alias("is_direct"),
        F.when(forward, F.col("src_id")).otherwise(F.col("dst_id")).alias("drug"),
        F.when(forward, F.col("dst_id")).otherwise(F.col("src_id")).alias("disease"),
    ).distinct()
    asked = pairs.select("drug", "disease").distinct()
    return oriented.join(asked, ["drug", "disease"], "left_semi").groupBy("edge_type", "is_direct").agg(
        F.count("*").alias("n_pairs")
    )


def negative_collisions(negatives: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct sampled negatives that are clinical pairs, by relation.

    An ``indication`` hit is a hard failure, any other relation a shadow.
    """
    sampled = negatives.select(F.col("neg_drug").alias("drug"), F.col("neg_disease").alias("disease")).distinct()
    forward = edges.filter((F.col("src_type") == DRUG) & (F.col("dst_type") == DISEASE))
    pairs = orient_pair(forward, DRUG, DISEASE, ("drug", "disease")).distinct()
    hit = pairs.join(sampled.withColumn("_hit", F.lit(1)), ["drug", "disease"], "left")
    return hit.groupBy("rel").agg(F.count("*").alias("n_relation_pairs"), F.count("_hit").alias("n_overlaps")).withColumn(
        "is_hard_failure", (F.col("rel") == "indication") & (F.col("n_overlaps") > 0)
    )


def overlap_pairs(train: DataFrame, external: DataFrame) -> DataFrame:
    """Pairs in both sets; must be empty."""
    return train.select("drug", "disease").intersect(external.select("drug", "disease"))


def cross_split_purity(splits: DataFrame, edges: DataFrame, mode: str) -> DataFrame:
    """Train and test entities, their overlap and test entities still in the graph.

    Only entity-level modes are checked; ``random`` gives no row.
    """
    if mode not in ("cross_drug", "cross_disease"):
        return splits.limit(0).select(
            F.lit(mode).alias("mode"),
            *[
                F.lit(0).cast("bigint").alias(c)
                for c in ("n_train_entities", "n_test_entities", "n_overlap", "n_still_in_graph")
            ],
        )
    entity, node_type = ("drug", DRUG) if mode == "cross_drug" else ("disease", DISEASE)
    roles = splits.groupBy(F.col(entity).alias("node_id")).agg(
        F.bool_or(F.col("split") == "train").alias("in_train"), F.bool_or(F.col("split") == "test").alias("in_test")
    )
    present = incidences(edges).filter(F.col("node_type") == node_type).select("node_id").distinct()
    joined = roles.join(present.withColumn("_p", F.lit(True)), "node_id", "left")
    return joined.agg(
        F.lit(mode).alias("mode"),
        F.count_if("in_train").alias("n_train_entities"),
        F.count_if("in_test").alias("n_test_entities"),
        F.count_if(F.col("in_train") & F.col("in_test")).alias("n_overlap"),
        F.count_if(F.col("in_test") & F.col("_p").isNotNull()).alias("n_still_in_graph"),
    )


def empty_path_ratio(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of pairs without a path, by batch and by sign.

    ``pairs`` has ``n_pos_paths`` and ``n_neg_paths``.
    """
    out = []
    for sign in ("pos", "neg"):
        empty = F.count_if(F.col(f"n_{sign}_paths") == 0)
        out += [empty.alias(f"{sign}_empty"), safe_ratio(empty, F.count("*")).alias(f"{sign}_empty_ratio")]
    return pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), *out)


# --- fixed values: node types a negative tail may have ---
TAIL_TYPES = ("disease", "phenotype", "disease/phenotype")
# --- end of fixed values ---


def negative_tail_types(negatives: DataFrame, nodes: DataFrame) -> DataFrame:
    """Negative tails by node type, and whether the type may be a tail."""
    tails = negatives.select(F.col("neg_disease").alias("global_id"))
    node_type = F.lower(F.trim("node_type"))
    return tails.join(nodes.select("global_id", "node_type"), "global_id").groupBy("node_type").agg(
        F.count("*").alias("n_negatives"), F.bool_and(node_type.isin(*TAIL_TYPES)).alias("is_valid")
    )


def relation_affix_report(edges: DataFrame) -> DataFrame:
    """Edge relations before and after affix removal, with their counts."""
    return edges.groupBy("rel").agg(F.count("*").alias("n_edges")).select(
        "rel",
        *[normalize_relation("rel", v).alias(f"{v}_rel") for v in ("plain", "batch", "sampler")],
        "n_edges",
    )
