"""Degrees, reachability and coverage of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import edge_type_label, joins_types
from ..functions.numeric import safe_ratio
from ..lineage import materialize
from ..schema import DISEASE, DRUG, GENE, PATHWAY
from .graph import EDGE_TYPE, disease_gene, drug_gene, edge_counts_by_type, gene_pathways
from .numbering import lower_median, number_globally, prefix_sums
from .paths import shared_genes


def incidences(edges: DataFrame) -> DataFrame:
    """Two rows per edge, one for each end: node, the type at the other end, edge type."""
    def end(this: str, other: str) -> Column:
        return F.struct(
            F.col(f"{this}_type").alias("node_type"),
            F.col(f"{this}_id").alias("node_id"),
            F.col(f"{other}_type").alias("other_type"),
        )

    return edges.select(*EDGE_TYPE, F.inline(F.array(end("src", "dst"), end("dst", "src"))))


def incident_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_type, global_id, degree); an edge within a type counts at both ends."""
    counts = incidences(edges).groupBy("node_type", F.col("node_id").alias("global_id")).agg(
        F.count("*").alias("degree")
    )
    return nodes.select("node_type", "global_id").join(counts, ["node_type", "global_id"], "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0)).cast("bigint")
    )


def degree_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node type: count, mean, lower median, maximum and zero-degree nodes."""
    degrees = incident_degree(edges, nodes)
    stats = degrees.groupBy("node_type").agg(
        F.count("*").alias("n_nodes"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("n_zero"),
    )
    return stats.join(lower_median(degrees, "degree", ["node_type"]), "node_type").withColumnRenamed(
        "median", "median_degree"
    )


def typed_degree(edges: DataFrame) -> DataFrame:
    """Per disease that has any edge: degree by kind of neighbour."""
    ends = incidences(edges).filter(F.col("node_type") == DISEASE)
    other = F.col("other_type")
    gene = (other != DISEASE) & other.contains("gene")
    phenotype = (other != DISEASE) & ~other.contains("gene") & other.contains("phenotype")
    return ends.groupBy(F.col("node_id").alias("disease")).agg(
        F.count_if(gene).alias("gene_degree"),
        F.count_if(phenotype).alias("phenotype_degree"),
        F.count_if(other == DISEASE).alias("disease_degree"),
        F.count_if(other != DRUG).alias("non_drug_degree"),
    )


def degree_by_split(splits: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree statistics of the diseases of each split."""
    diseases = splits.select("split", "disease").distinct()
    degrees = ("gene_degree", "phenotype_degree", "disease_degree", "non_drug_degree")
    joined = diseases.join(typed_degree(edges), "disease", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in degrees}
    )
    effective = F.col("gene_degree") + F.col("phenotype_degree")
    zero, island = F.count_if(effective == 0), F.count_if(F.col("non_drug_degree") == 0)
    return joined.groupBy("split").agg(
        F.count("*").alias("n_diseases"),
        F.avg(effective).alias("mean_effective_degree"),
        *[F.avg(c).alias(f"mean_{c}") for c in degrees],
        zero.alias("n_zero_effective"),
        safe_ratio(zero, F.count("*")).alias("zero_effective_ratio"),
        island.alias("n_islands"),
        safe_ratio(island, F.count("*")).alias("island_ratio"),
    )


def pair_path_counts(pairs: DataFrame, edges: DataFrame, links: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per distinct pair: shared genes, genes with a pathway, quads through all, star paths.

    Quads are counted from the number of pathways per gene, not enumerated; a
    gene without a pathway contributes its one dummy path to ``n_quads`` only. ``links``
    are the ``gene_links`` of the edges where these are stored.
    """
    distinct = pairs.select("drug", "disease").distinct()
    drug_genes, disease_genes = links if links is not None else (drug_gene(edges), disease_gene(edges))
    shared = shared_genes(distinct, drug_genes, disease_genes)
    per_gene = gene_pathways(edges).groupBy("gene").agg(F.count("*").alias("_np"))
    n = F.coalesce(F.col("_np"), F.lit(0))
    counts = shared.join(per_gene, "gene", "left").groupBy("drug", "disease").agg(
        F.count("*").alias("n_shared_genes"),
        F.count_if(n > 0).alias("n_star_genes"),
        F.sum(F.greatest(n, F.lit(1))).alias("n_quads"),
        F.sum(n).alias("n_star_paths"),
    )
    names = ("n_shared_genes", "n_star_genes", "n_quads", "n_star_paths")
    return distinct.join(counts, ["drug", "disease"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in names}
    )


def path_reachability(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """How many pairs any topology path reaches, and how many paths they have."""
    n = F.col("n_quads")
    reachable = F.count_if(n > 0)
    return pair_path_counts(pairs, edges).agg(
        F.count("*").alias("n_pairs"),
        reachable.alias("n_reachable"),
        F.count_if(n == 0).alias("n_unreachable"),
        safe_ratio(reachable, F.count("*")).alias("reachable_ratio"),
        F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0)).alias("mean_paths_reachable"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_paths"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_paths"),
    )


def star_reachability(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs reachable through a shared gene, and through one with a pathway."""
    def mean(c: str) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c.removeprefix('n_')}")

    shared, star = F.count_if(F.col("n_shared_genes") > 0), F.count_if(F.col("n_star_genes") > 0)
    return pair_path_counts(pairs, edges).agg(
        F.count("*").alias("n_pairs"),
        shared.alias("n_with_shared_gene"),
        safe_ratio(shared, F.count("*")).alias("shared_gene_ratio"),
        star.alias("n_star_reachable"),
        safe_ratio(star, F.count("*")).alias("star_ratio"),
        mean("n_shared_genes"),
        mean("n_star_genes"),
        mean("n_star_paths"),
        F.coalesce(F.max("n_star_paths"), F.lit(0)).alias("max_star_paths"),
    )


def path_coverage(splits: DataFrame, triplets: DataFrame) -> DataFrame:
    """Per split: pairs, pairs with a triplet, their share and the triplet count."""
    pairs = splits.select("split", "drug", "disease").distinct()
    per_pair = triplets.groupBy("split", "drug", "disease").agg(F.count("*").alias("_n"))
    joined = pairs.join(per_pair, ["split", "drug", "disease"], "left")
    covered = F.count("_n")
    return joined.groupBy("split").agg(
        F.count("*").alias("n_pairs"),
        covered.alias("n_covered"),
        safe_ratio(covered, F.count("*")).alias("coverage"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_triplets"),
    )


def uncovered_pairs(splits: DataFrame, triplets: DataFrame) -> DataFrame:
    keys = ["split", "drug", "disease"]
    return splits.select(*keys).distinct().join(triplets, keys, "left_anti")


def island_diseases(raw: DataFrame, clean: DataFrame, diseases: DataFrame) -> DataFrame:
    """Diseases without a gene link after cleaning, and whether they had one before."""
    def degree(edges: DataFrame, out: str) -> DataFrame:
        return disease_gene(edges).groupBy("disease").agg(F.count("*").alias(out))

    asked = diseases.select("disease").distinct()
    joined = asked.join(degree(raw, "raw_degree"), "disease", "left").join(degree(clean, "clean_degree"), "disease", "left")
    return joined.filter("clean_degree is null").select(
        "disease",
        F.coalesce("raw_degree", F.lit(0)).cast("bigint").alias("raw_degree"),
        F.when(F.col("raw_degree").isNull(), "originally_missing").otherwise("removed_by_clean").alias("cause"),
    )


def island_report(raw: DataFrame, clean: DataFrame, diseases: DataFrame) -> DataFrame:
    islands = island_diseases(raw, clean, diseases)
    total = diseases.select(F.count_distinct("disease").alias("n")).scalar()
    missing = F.count_if(F.col("cause") == "originally_missing")
    removed = F.count_if(F.col("cause") == "removed_by_clean")
    return islands.agg(
        F.count("*").alias("n_islands"), missing.alias("n_originally_missing"), removed.alias("n_removed_by_clean")
    ).select(
        total.alias("n_diseases"),
        "*",
        safe_ratio(F.col("n_islands"), F.greatest(total, F.lit(1))).alias("island_ratio"),
        safe_ratio(F.col("n_originally_missing"), F.col("n_islands")).alias("originally_missing_ratio"),
        safe_ratio(F.col("n_removed_by_clean"), F.col("n_islands")).alias("removed_ratio"),
    )


def island_edge_types(raw: DataFrame, clean: DataFrame, diseases: DataFrame) -> DataFrame:
    """Raw gene edges, by edge type, of diseases that cleaning turned into islands."""
    removed = island_diseases(raw, clean, diseases).filter("cause = 'removed_by_clean'").select("disease")
    links = raw.filter(joins_types(DISEASE, GENE)).select(
        edge_type_label().alias("edge_type"),
        F.when(F.col("src_type") == DISEASE, F.col("src_id")).otherwise(F.col("dst_id")).alias("disease"),
    )
    return links.join(removed, "disease", "left_semi").groupBy("edge_type").agg(F.count("*").alias("n_edges"))


def edge_type_audit(edges: DataFrame) -> DataFrame:
    """Edge counts by type with the topology group the type belongs to."""
    group = (
        F.when(joins_types(DRUG, PATHWAY), "drug_pathway")
        .when(joins_types(DISEASE, PATHWAY), "disease_pathway")
        .when((F.col("src_type") == GENE) | (F.col("dst_type") == GENE), "gene_connected")
        .otherwise("other")
    )
    return edge_counts_by_type(edges).withColumn("topology_group", group)


def eval_entity_degree(entities: DataFrame, node_type: str, edges: DataFrame) -> DataFrame:
    """Mean degree of evaluated entities: over all edges and without the opposite type.

    For diseases the second figure leaves out drug edges, for drugs edges with a
    disease-like end. ``entities`` has a column ``node_id``.
    """
    ends = incidences(edges).filter(F.col("node_type") == node_type)
    if node_type == DISEASE:
        counted = (F.col("src_type") != DRUG) & (F.col("dst_type") != DRUG)
    else:
        counted = ~F.col("src_type").contains(DISEASE) & ~F.col("dst_type").contains(DISEASE)
    per_node = ends.groupBy("node_id").agg(F.count("*").alias("_all"), F.count_if(counted).alias("_kept"))
    joined = entities.select("node_id").distinct().join(per_node, "node_id", "left")
    return joined.agg(
        F.count("*").alias("n_entities"),
        safe_ratio(F.sum("_all"), F.count("*")).alias("mean_degree"),
        safe_ratio(F.sum("_kept"), F.count("*")).alias("mean_restricted_degree"),
    )


def hardest_diseases(diseases: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(disease, effective_degree) of the ``k`` diseases with fewest gene and phenotype links; ties by id.

    Counts per degree say up to which one all diseases belong; only those of the degree that is cut are ordered.
    """
    degree = typed_degree(edges).select("disease", (F.col("gene_degree") + F.col("phenotype_degree")).alias("effective_degree"))
    ranked = diseases.select("disease").distinct().join(degree, "disease", "left").withColumn(
        "effective_degree", F.coalesce("effective_degree", F.lit(0)).cast("bigint")
    )
    ranked = materialize(ranked, "degrees")
    counts = materialize(ranked.groupBy(F.col("effective_degree").cast("double").alias("d")).agg(F.count("*").alias("n")), "counts")
    places = materialize(prefix_sums(counts, "d", ["n"]).filter(F.col("n_before") < k), "places")
    whole, cut = places.filter(F.col("n_before") + F.col("n") <= k), places.filter(F.col("n_before") + F.col("n") > k)
    same = F.col("effective_degree") == F.col("d")
    tied = number_globally(ranked.join(cut.select("d", "n_before"), same), ["disease"], "_place")
    last = tied.filter(F.col("_place") + F.col("n_before") < k).select(*ranked.columns)
    return ranked.join(whole.select("d"), same, "left_semi").unionByName(last)
