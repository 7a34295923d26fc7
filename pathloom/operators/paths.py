"""Mechanism paths: enumeration over genes, pair-restricted paths, path banks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import orient_pair
from ..functions.keyed import HASH_SPACE, key_hash
from ..lineage import materialize
from ..schema import DISEASE, DRUG, DUMMY_PATHWAY, GENE
from .graph import direct_pairs, disease_gene, drug_gene, gene_pathways
from .ordered import list_chunks

# A gene whose paths exceed this count is enumerated by several tasks.
PATHS_PER_TASK = 2_000_000
# Paths of a pair in one row of a chunked export.
PATHS_PER_ROW = 10_000
# A disease with more paths is not put together from lists of drugs, a pair with more is not listed in one task.
PATHS_PER_LIST = 100_000
# Ids of drugs, or of diseases, of one gene that are gathered in one place.
ENDS_PER_TASK = 1 << 18


def mechanism_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (drug, gene) of ``targets`` and (disease, gene) of ``disease_protein`` edges."""
    def link(src_type: str, rel: str, name: str) -> DataFrame:
        hit = (F.col("src_type") == src_type) & (F.col("rel") == rel) & (F.col("dst_type") == GENE)
        return edges.filter(hit).select(F.col("src_id").alias(name), F.col("dst_id").alias("gene")).distinct()

    return link(DRUG, "targets", "drug"), link(DISEASE, "disease_protein", "disease")


def join_sliced(left: DataFrame, right: DataFrame, on: str, paths_per_task: int = PATHS_PER_TASK) -> DataFrame:
    """All (left, right) combinations per value of ``on``, hub values spread over many tasks.

    The slices of a hub's left rows meet a copy of its right rows each, and both
    sides are dealt to as many tasks as the counted combinations need, so a task
    emits about ``paths_per_task`` rows however skewed the values are and however few bytes the sides have.
    """
    n_left = left.groupBy(on).agg(F.count("*").alias("_nl"))
    n_right = right.groupBy(on).agg(F.count("*").alias("_nr"))
    paths = (F.col("_nl") * F.col("_nr")).alias("_paths")
    met = materialize(n_left.join(n_right, on).select(on, "_nl", paths), "met")
    total = met.agg(F.sum("_paths")).first()[0] or 0
    hubs = met.filter(F.col("_paths") > paths_per_task).select(
        on, F.least("_nl", F.ceil(F.col("_paths") / F.lit(paths_per_task))).cast("int").alias("_slices")
    )
    # at most (number of paths) / paths_per_task values are hubs
    hubs = F.broadcast(hubs)
    key = [c for c in left.columns if c != on]
    part = F.floor(key_hash("slice", *key).cast("double") / F.lit(HASH_SPACE) * F.col("_slices")).cast("int")
    sliced = left.join(hubs, on, "left").withColumn("_slice", F.coalesce(part, F.lit(0))).drop("_slices")
    # a hash fraction may round up to 1, so slices run from 0 to _slices inclusive
    copies = F.sequence(F.lit(0), F.coalesce("_slices", F.lit(0)))
    copied = right.join(hubs, on, "left").withColumn("_slice", F.explode(copies)).drop("_slices")
    tasks = -(-total // paths_per_task)
    if tasks > 1:
        sliced, copied = sliced.repartition(tasks, on, "_slice"), copied.repartition(tasks, on, "_slice")
    return sliced.join(copied, [on, "_slice"]).drop("_slice")


def join_on_gene(left: DataFrame, right: DataFrame, paths_per_task: int = PATHS_PER_TASK) -> DataFrame:
    return join_sliced(left, right, "gene", paths_per_task)


def topology_paths(edges: DataFrame) -> DataFrame:
    """Every (drug, gene, disease) over any drug-gene and disease-gene edge."""
    return join_on_gene(drug_gene(edges), disease_gene(edges)).select("drug", "gene", "disease")


def real_quads(edges: DataFrame, pathway_relations=None) -> DataFrame:
    """Every (drug, gene, pathway, disease) mechanism of the graph.

    Pathways are attached to the disease side before the path join, so the
    paths themselves, the largest table, are never shuffled.
    """
    disease_side = expand_to_quads(disease_gene(edges), gene_pathways(edges, pathway_relations))
    return join_on_gene(drug_gene(edges), disease_side).select("drug", "gene", "pathway", "disease")


def expand_to_quads(triplets: DataFrame, pathways: DataFrame, distinct: bool = False) -> DataFrame:
    """Add each pathway of the gene; the dummy id where it has none.

    Four-column input passes through.
    """
    if "pathway" in triplets.columns:
        return triplets.distinct() if distinct else triplets
    out = triplets.join(pathways, "gene", "left").withColumn(
        "pathway", F.coalesce("pathway", F.lit(DUMMY_PATHWAY).cast("bigint"))
    )
    columns = [c for c in ("drug", "gene", "pathway", "disease") if c in out.columns]
    extra = [c for c in out.columns if c not in columns]
    out = out.select(*columns, *extra)
    return out.distinct() if distinct else out


def mark_dummy(quads: DataFrame) -> DataFrame:
    return quads.withColumn("is_dummy", F.col("pathway") == DUMMY_PATHWAY)


def shared_genes(pairs: DataFrame, drug_genes: DataFrame, disease_genes: DataFrame) -> DataFrame:
    """(pair columns, gene) for genes linked to both ends of a pair.

    Each pair is expanded through whichever of its ends has fewer genes, so the
    intermediate rows are the smaller side of every pair and never the paths of
    a hub gene, drug or disease.
    """
    n_drug = drug_genes.groupBy("drug").agg(F.count("*").alias("_nd"))
    n_disease = disease_genes.groupBy("disease").agg(F.count("*").alias("_ns"))
    sized = materialize(pairs.join(n_drug, "drug").join(n_disease, "disease"), "sized")
    by_drug, by_disease = sized.filter("_nd <= _ns").drop("_nd", "_ns"), sized.filter("_nd > _ns").drop("_nd", "_ns")
    columns = [*pairs.columns, "gene"]
    through_disease = by_disease.join(disease_genes, "disease").join(drug_genes, ["drug", "gene"], "left_semi").select(*columns)
    if by_drug.isEmpty():
        return through_disease
    through_drug = by_drug.join(drug_genes, "drug").join(disease_genes, ["disease", "gene"], "left_semi").select(*columns)
    return through_drug.unionByName(through_disease)


def pair_triplets(edges: DataFrame, pair_splits: DataFrame) -> DataFrame:
    """(split, drug, gene, disease) mechanisms of known pairs.

    A pair listed under several splits belongs to the last of them.
    """
    drug_genes, disease_genes = mechanism_links(edges)
    return shared_genes(last_split(pair_splits), drug_genes, disease_genes).select("split", "drug", "gene", "disease")


def last_split(pair_splits: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(s) for s in ("train", "valid", "test", "ot")]), F.col("split"))
    return pair_splits.groupBy("drug", "disease").agg(F.max_by("split", order).alias("split"))


def capped_triplets(
    edges: DataFrame,
    per_gene_drugs: int = 12,
    per_gene_diseases: int = 12,
    per_pair: int = 4,
    max_pairs: int = 256,
) -> DataFrame:
    """A small table of real triplets, first come first served in id order.

    The caps are the operator: it serves sanity checks on a bounded sample.
    """
    def capped(df: DataFrame, name: str, cap: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("gene").orderBy(name))
        return df.withColumn("_r", rank).filter(F.col("_r") <= cap).drop("_r")

    drug_genes, disease_genes = mechanism_links(edges)
    triplets = capped(drug_genes, "drug", per_gene_drugs).join(capped(disease_genes, "disease", per_gene_diseases), "gene")
    pairs = (
        triplets.groupBy("drug", "disease").agg(F.min("gene").alias("_first"))
        .orderBy("_first", "drug", "disease").limit(max_pairs).drop("_first")
    )
    rank = F.row_number().over(Window.partitionBy("drug", "disease").orderBy("gene"))
    return (
        triplets.join(pairs, ["drug", "disease"]).withColumn("_r", rank).filter(F.col("_r") <= per_pair)
        .select("drug", "gene", "disease")
    )


def positive_bank(positive: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Distinct paths; pairs present in ``external`` take their paths from there only."""
    own = positive.distinct()
    if external is None:
        return own
    theirs = external.distinct()
    return own.join(theirs.select("drug", "disease"), ["drug", "disease"], "left_anti").select(*own.columns).unionByName(
        theirs.select(*own.columns)
    )


def topology_bank(topology: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Topology paths merged with external ones."""
    if external is None:
        return topology
    return topology.unionByName(external.select(*topology.columns)).distinct()


def gene_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drug, gene) and (disease, gene) of ``drug_gene`` and ``disease_gene``, written in the order of genes.

    A gene's rows lie together, so lists and counts of a gene are complete before they are shuffled; those of a hub
    gene lie in as many places as its ids take ranges of ``ENDS_PER_TASK``.
    """
    def written(df: DataFrame, end: str) -> DataFrame:
        # gathered by gene first, so that making rows distinct moves them no second time
        gathered = df.withColumn("_part", F.floor(F.col(end) / ENDS_PER_TASK)).repartition("gene", "_part")
        return materialize(gathered.distinct().sortWithinPartitions("gene", end).drop("_part"), f"{end}_genes")

    return (
        written(orient_pair(edges, DRUG, GENE, ("drug", "gene")).select("drug", "gene"), "drug"),
        written(orient_pair(edges, DISEASE, GENE, ("disease", "gene")).select("disease", "gene"), "disease"),
    )


def connected_pairs(
    edges: DataFrame,
    most: int = PATHS_PER_LIST,
    paths_per_task: int = PATHS_PER_TASK,
    links: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Distinct (drug, disease) joined by at least one gene.

    A gene's drugs go to its diseases as one list, and each disease makes the drugs of its lists
    distinct, so lists are shuffled and not paths. Diseases of more than ``most`` paths, and those of a
    hub gene, have their paths enumerated. ``links`` are the ``gene_links`` of the edges where these are stored.
    """
    drug_genes, disease_genes = links if links is not None else gene_links(edges)
    n_drugs = drug_genes.groupBy("gene").agg(F.count("*").alias("_nd"))
    n_diseases = disease_genes.groupBy("gene").agg(F.count("*").alias("_ns"))
    met = n_drugs.join(n_diseases, "gene").withColumn("_hub", F.col("_nd") * F.col("_ns") > paths_per_task)
    sized = disease_genes.join(met, "gene").groupBy("disease").agg(F.sum("_nd").alias("_paths"), F.bool_or("_hub").alias("_hub"))
    large = materialize(sized.filter((F.col("_paths") > most) | F.col("_hub")).select("disease"), "large")
    if large.isEmpty():
        return _pairs_by_lists(drug_genes, disease_genes)
    few = materialize(disease_genes.join(large, "disease", "left_anti"), "few")
    # the genes of the others have at most ``most`` drugs
    listed = _pairs_by_lists(drug_genes, few)
    many = join_on_gene(drug_genes, disease_genes.join(large, "disease", "left_semi"), paths_per_task)
    return listed.unionByName(many.select("drug", "disease").distinct())


def _pairs_by_lists(drug_genes: DataFrame, disease_genes: DataFrame) -> DataFrame:
    linked = drug_genes.join(disease_genes.select("gene").distinct(), "gene", "left_semi")
    lists = linked.groupBy("gene").agg(F.collect_list("drug").alias("_drugs"))
    drugs = F.array_distinct(F.flatten(F.collect_list("_drugs"))).alias("_drugs")
    per_disease = disease_genes.join(lists, "gene").groupBy("disease").agg(drugs)
    return per_disease.select(F.explode("_drugs").alias("drug"), "disease")


def nested_paths(paths: DataFrame) -> DataFrame:
    """One row per pair with its paths as a sorted array, for export; ``nested_path_chunks`` bounds the rows."""
    inner = [c for c in ("gene", "pathway") if c in paths.columns]
    return paths.groupBy("drug", "disease").agg(
        F.sort_array(F.collect_list(F.struct(*inner))).alias("paths"), F.count("*").alias("n_paths")
    )


def nested_path_chunks(paths: DataFrame, most: int = PATHS_PER_ROW, per_list: int = PATHS_PER_LIST) -> DataFrame:
    """(drug, disease, chunk, paths): the sorted distinct paths of a pair, ``most`` to a row but the last.

    The paths of a pair meet once and are cut there. Only pairs of more than ``per_list`` rows are cut over a range-sorted table.
    """
    inner = [c for c in ("gene", "pathway") if c in paths.columns]
    paths = paths.select("drug", "disease", *inner)
    large = paths.groupBy("drug", "disease").agg(F.count("*").alias("_n")).filter(F.col("_n") > per_list)
    large = materialize(large.select("drug", "disease"), "large")
    if large.isEmpty():
        return _cut_in_place(paths, inner, most)
    # at most (number of rows) / per_list pairs are large
    listed = _cut_in_place(paths.join(F.broadcast(large), ["drug", "disease"], "left_anti"), inner, most)
    many = paths.join(F.broadcast(large), ["drug", "disease"], "left_semi").distinct()
    return listed.unionByName(list_chunks(many, ["drug", "disease"], inner, most, "paths"))


def _cut_in_place(paths: DataFrame, inner: list[str], most: int) -> DataFrame:
    listed = paths.groupBy("drug", "disease").agg(F.sort_array(F.collect_set(F.struct(*inner))).alias("_all"))
    starts = F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / most).cast("int"))
    cut = listed.select("drug", "disease", "_all", F.explode(starts).alias("_c"))
    return cut.select("drug", "disease", F.col("_c").cast("bigint").alias("chunk"), F.slice("_all", F.col("_c") * most + 1, most).alias("paths"))


def known_positive_pairs(positives: DataFrame, edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Pairs of positive paths, of clinical edges and of any extra rows."""
    pairs = positives.select("drug", "disease").unionByName(direct_pairs(edges, "sampler").select("drug", "disease"))
    if extra is not None:
        pairs = pairs.unionByName(extra.select("drug", "disease"))
    return pairs.distinct()


def first_path_per_pair(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """One path per pair, the smallest; a pair without any gets an all-zero path."""
    inner = [c for c in ("gene", "pathway") if c in paths.columns]
    best = paths.groupBy("drug", "disease").agg(F.min(F.struct(*inner)).alias("_p"))
    return pairs.select("drug", "disease").distinct().join(best, ["drug", "disease"], "left").select(
        "drug",
        "disease",
        *[F.coalesce(F.col(f"_p.{c}"), F.lit(0).cast("bigint")).alias(c) for c in inner],
        F.col("_p").isNotNull().alias("has_path"),
    )


def target_subset(triplets: DataFrame, subset: str) -> DataFrame:
    """Held-out triplets of the valid, the test or both splits."""
    names = {"valid": ["valid"], "test": ["test"], "heldout": ["valid", "test"]}[subset]
    return triplets.filter(F.col("split").isin(*names)).drop("split").distinct()
