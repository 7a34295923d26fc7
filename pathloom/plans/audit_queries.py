"""Topology, leakage and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.graph import entity_label, pair_label
from ..operators import audits as au
from ..operators import graph as gr
from ..operators import paths as pa
from ..operators import topology as to
from ..schema import DISEASE, DRUG
from .derived import clean_edges, splits, triplets
from .graph_store import graph
from .oracle import expect
from .registry import query


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_ENDS = """, ends AS (
  SELECT src_type AS node_type, src_id AS node_id, dst_type AS other, src_type, dst_type FROM {edges}
  UNION ALL SELECT dst_type, dst_id, src_type, src_type, dst_type FROM {edges})"""


@query(
    "degree_summary",
    expect(
        ("nodes", "edges"),
        _ENDS.format(edges="edges")
        + """ SELECT node_type, count(*) AS n_nodes, round(avg(d), 6) AS mean_degree, max(d) AS max_degree, count(*) FILTER (WHERE d = 0) AS n_zero,
  quantile_disc(d, 0.5)::DOUBLE AS median_degree FROM (SELECT n.node_type, n.global_id, count(e.node_id) AS d FROM nodes n
  LEFT JOIN ends e ON e.node_type = n.node_type AND e.node_id = n.global_id GROUP BY ALL) GROUP BY node_type""",
    ),
)
def degree_summary(spark, sf_dir):
    g = graph(spark, sf_dir)
    return rounded(to.degree_summary(g.edges, g.nodes), "mean_degree")


_TYPED = """, td AS (SELECT node_id AS disease, count(*) FILTER (WHERE other = 'gene/protein') AS gene_degree, 0 AS phenotype_degree, 0 AS disease_degree,
  count(*) FILTER (WHERE other <> 'drug') AS non_drug_degree FROM ends WHERE node_type = 'disease' GROUP BY node_id)"""


@query("typed_degree", expect("edges", _ENDS.format(edges="edges") + _TYPED + " SELECT * FROM td"))
def typed_degree(spark, sf_dir):
    return to.typed_degree(graph(spark, sf_dir).edges)


@query(
    "degree_by_split",
    expect(
        ("split_cross_disease", "clean"),
        _ENDS.format(edges="clean")
        + _TYPED
        + """ SELECT split, count(*) AS n_diseases, round(avg(g), 6) AS mean_effective_degree, round(avg(g), 6) AS mean_gene_degree,
  0::DOUBLE AS mean_phenotype_degree, 0::DOUBLE AS mean_disease_degree, round(avg(n), 6) AS mean_non_drug_degree, count(*) FILTER (WHERE g = 0) AS n_zero_effective,
  round(avg(CASE WHEN g = 0 THEN 1 ELSE 0 END), 6) AS zero_effective_ratio, count(*) FILTER (WHERE n = 0) AS n_islands, round(avg(CASE WHEN n = 0 THEN 1 ELSE 0 END), 6) AS island_ratio
  FROM (SELECT split, disease, coalesce(gene_degree, 0) AS g, coalesce(non_drug_degree, 0) AS n FROM (SELECT DISTINCT split, disease FROM split_cross_disease) LEFT JOIN td USING (disease)) GROUP BY split""",
    ),
)
def degree_by_split(spark, sf_dir):
    out = to.degree_by_split(splits(spark, sf_dir, "cross_disease"), clean_edges(spark, sf_dir))
    means = [c for c in out.columns if c.startswith("mean_") or c.endswith("_ratio")]
    return rounded(out, *means)


_TEST_QUADS = """, per_pair AS (SELECT drug, disease, count(pathway) AS n FROM (SELECT DISTINCT drug, disease FROM split_random WHERE split = 'test') LEFT JOIN quads USING (drug, disease) GROUP BY ALL)"""


@query(
    "path_reachability",
    expect(
        ("split_random", "quads"),
        _TEST_QUADS
        + """ SELECT count(*) AS n_pairs, count(*) FILTER (WHERE n > 0) AS n_reachable, count(*) FILTER (WHERE n = 0) AS n_unreachable,
  round(count(*) FILTER (WHERE n > 0) / count(*), 6) AS reachable_ratio, round(coalesce(avg(n) FILTER (WHERE n > 0), 0), 6) AS mean_paths_reachable, round(avg(n), 6) AS mean_paths, max(n) AS max_paths FROM per_pair""",
    ),
)
def path_reachability(spark, sf_dir):
    test = splits(spark, sf_dir, "random").filter("split = 'test'")
    out = to.path_reachability(test, graph(spark, sf_dir).edges)
    return rounded(out, "reachable_ratio", "mean_paths_reachable", "mean_paths")


@query(
    "star_reachability",
    expect(
        ("pairs", "triplets", "gp"),
        """, per_gene AS (SELECT drug, disease, gene, (SELECT count(*) FROM gp WHERE gp.gene = t.gene) AS np FROM (SELECT drug, disease FROM pairs) JOIN triplets t USING (drug, disease)),
  pp AS (SELECT drug, disease, count(gene) AS sh, count(*) FILTER (WHERE np > 0) AS st, coalesce(sum(np), 0) AS sp FROM (SELECT drug, disease FROM pairs) LEFT JOIN per_gene USING (drug, disease) GROUP BY ALL)
  SELECT count(*) AS n_pairs, count(*) FILTER (WHERE sh > 0) AS n_with_shared_gene, round(count(*) FILTER (WHERE sh > 0) / count(*), 6) AS shared_gene_ratio,
  count(*) FILTER (WHERE st > 0) AS n_star_reachable, round(count(*) FILTER (WHERE st > 0) / count(*), 6) AS star_ratio,
  round(avg(sh), 6) AS mean_shared_genes, round(avg(st), 6) AS mean_star_genes, round(avg(sp), 6) AS mean_star_paths, max(sp)::BIGINT AS max_star_paths FROM pp""",
    ),
)
def star_reachability(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    out = to.star_reachability(gr.pair_relations(edges), edges)
    return rounded(out, "shared_gene_ratio", "star_ratio", "mean_shared_genes", "mean_star_genes", "mean_star_paths")


@query(
    "path_coverage",
    expect(
        ("split_cross_drug", "pt_cross_drug"),
        """SELECT split, count(*) AS n_pairs, count(n) AS n_covered, round(count(n) / count(*), 6) AS coverage, coalesce(sum(n), 0)::BIGINT AS n_triplets
  FROM split_cross_drug LEFT JOIN (SELECT split, drug, disease, count(*) AS n FROM pt_cross_drug GROUP BY ALL) USING (split, drug, disease) GROUP BY split""",
    ),
)
def path_coverage(spark, sf_dir):
    out = to.path_coverage(splits(spark, sf_dir, "cross_drug"), triplets(spark, sf_dir, "cross_drug"))
    return rounded(out, "coverage")


@query(
    "uncovered_pairs",
    expect(
        ("split_cross_drug", "pt_cross_drug"),
        """SELECT split, drug, disease FROM split_cross_drug s WHERE NOT EXISTS
  (SELECT 1 FROM pt_cross_drug t WHERE t.split = s.split AND t.drug = s.drug AND t.disease = s.disease)""",
    ),
)
def uncovered_pairs(spark, sf_dir):
    return to.uncovered_pairs(splits(spark, sf_dir, "cross_drug"), triplets(spark, sf_dir, "cross_drug"))


# the strict cleaning of the random split, which can turn diseases into islands
_STRICT = """, held AS (SELECT DISTINCT drug, gene, disease FROM pt_random WHERE split IN ('valid', 'test')),
  asked AS (SELECT DISTINCT disease FROM split_random),
  isl AS (SELECT disease, (SELECT count(*) FROM sg WHERE sg.disease = a.disease) AS raw_degree FROM asked a WHERE NOT EXISTS
    (SELECT 1 FROM sg WHERE sg.disease = a.disease AND NOT EXISTS (SELECT 1 FROM held x WHERE x.disease = sg.disease AND x.gene = sg.gene)))"""


def _strict(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    held = pa.target_subset(triplets(spark, sf_dir, "random"), "heldout")
    return edges, gr.remove_path_edges(edges, held), splits(spark, sf_dir, "random").select("disease")


@query(
    "island_diseases",
    expect(
        ("split_random", "pt_random", "sg"),
        _STRICT + " SELECT disease, raw_degree, CASE WHEN raw_degree = 0 THEN 'originally_missing' ELSE 'removed_by_clean' END AS cause FROM isl",
    ),
)
def island_diseases(spark, sf_dir):
    return to.island_diseases(*_strict(spark, sf_dir))


@query(
    "islands",
    expect(
        ("split_random", "pt_random", "sg"),
        _STRICT
        + """ SELECT (SELECT count(*) FROM asked) AS n_diseases, count(*) AS n_islands, count(*) FILTER (WHERE raw_degree = 0) AS n_originally_missing,
  count(*) FILTER (WHERE raw_degree > 0) AS n_removed_by_clean, round(count(*) / (SELECT count(*) FROM asked), 6) AS island_ratio,
  round(coalesce(count(*) FILTER (WHERE raw_degree = 0) / nullif(count(*), 0), 0), 6) AS originally_missing_ratio, round(coalesce(count(*) FILTER (WHERE raw_degree > 0) / nullif(count(*), 0), 0), 6) AS removed_ratio FROM isl""",
    ),
)
def islands(spark, sf_dir):
    out = to.island_report(*_strict(spark, sf_dir))
    return rounded(out, "island_ratio", "originally_missing_ratio", "removed_ratio")


@query(
    "island_edge_types",
    expect(
        ("split_random", "pt_random", "sg"),
        _STRICT
        + """ SELECT 'disease|disease_protein|gene/protein' AS edge_type, sum(raw_degree)::BIGINT AS n_edges FROM isl HAVING sum(raw_degree) > 0""",
    ),
)
def island_edge_types(spark, sf_dir):
    return to.island_edge_types(*_strict(spark, sf_dir))


@query(
    "edge_type_audit",
    expect(
        "clean",
        """SELECT src_type, rel, dst_type, count(*) AS n_edges, CASE WHEN src_type = 'gene/protein' OR dst_type = 'gene/protein' THEN 'gene_connected' ELSE 'other' END AS topology_group
  FROM clean GROUP BY src_type, rel, dst_type""",
    ),
)
def edge_type_audit(spark, sf_dir):
    return to.edge_type_audit(clean_edges(spark, sf_dir))


@query(
    "direct_shadow_hits",
    expect(
        ("direct", "split_random"),
        """SELECT 'drug|' || rel || '|disease' AS edge_type, rel = 'indication' OR rel = 'off-label use' OR rel = 'contraindication' AS is_direct, count(DISTINCT (drug, disease)) AS n_pairs
  FROM direct JOIN split_random USING (drug, disease) WHERE split IN ('valid', 'test') GROUP BY ALL
  UNION ALL SELECT 'disease|treated_by|drug', false, count(DISTINCT (drug, disease)) FROM direct JOIN split_random USING (drug, disease) WHERE split IN ('valid', 'test') AND rel = 'indication'
  HAVING count(*) > 0""",
    ),
)
def direct_shadow_hits(spark, sf_dir):
    """Held-out pairs against the raw graph plus one reversed relation that is not clinical by name."""
    edges = graph(spark, sf_dir).edges
    shadow = edges.filter("rel = 'indication'").selectExpr(
        "dst_id as src_id", "dst_type as src_type", "'treated_by' as rel", "src_type as dst_type", "src_id as dst_id"
    )
    held = splits(spark, sf_dir, "random").filter("split in ('valid', 'test')")
    return au.direct_shadow_hits(held, edges.unionByName(shadow))


@query(
    "external_overlap",
    expect(
        ("split_random", "split_cross_drug"),
        """SELECT drug, disease FROM split_random WHERE split = 'train' INTERSECT SELECT drug, disease FROM split_cross_drug WHERE split = 'ot'""",
    ),
)
def external_overlap(spark, sf_dir):
    train = splits(spark, sf_dir, "random").filter("split = 'train'")
    external = splits(spark, sf_dir, "cross_drug").filter("split = 'ot'")
    return au.overlap_pairs(train, external)


@query(
    "cross_split_purity",
    expect(
        ("split_cross_drug", "clean"),
        """SELECT 'cross_drug' AS mode, count(DISTINCT drug) FILTER (WHERE split = 'train') AS n_train_entities, count(DISTINCT drug) FILTER (WHERE split = 'test') AS n_test_entities,
  0 AS n_overlap, count(DISTINCT drug) FILTER (WHERE split = 'test' AND drug IN (SELECT src_id FROM clean WHERE src_type = 'drug')) AS n_still_in_graph FROM split_cross_drug""",
    ),
)
def cross_split_purity(spark, sf_dir):
    return au.cross_split_purity(splits(spark, sf_dir, "cross_drug"), clean_edges(spark, sf_dir), "cross_drug")


@query(
    "residual_edges",
    expect(
        ("pt_random", "gp", "edges"),
        """, hq AS (SELECT DISTINCT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM pt_random LEFT JOIN gp USING (gene) WHERE split = 'test')
  SELECT 'reverse_disease_to_gene' AS kind, 'disease|disease_protein|gene/protein' AS edge_type, drug, gene, pathway, disease FROM hq
    JOIN edges ON rel = 'disease_protein' AND src_id = disease AND dst_id = gene
  UNION ALL SELECT 'shortcut_drug_to_disease', 'drug|' || rel || '|disease', drug, gene, pathway, disease FROM hq
    JOIN edges ON src_type = 'drug' AND dst_type = 'disease' AND src_id = drug AND dst_id = disease""",
    ),
)
def residual_edges(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    test = pa.target_subset(triplets(spark, sf_dir, "random"), "test")
    return au.residual_edges(edges, pa.expand_to_quads(test, gr.gene_pathways(edges)))


@query(
    "residual_summary",
    expect(
        ("pt_random", "gp", "clean"),
        """, hq AS (SELECT DISTINCT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM pt_random LEFT JOIN gp USING (gene))
  SELECT kind, edge_type, count(*) AS n_hits, count(DISTINCT (drug, gene, pathway, disease)) AS n_quads FROM (
  SELECT 'reverse_disease_to_gene' AS kind, 'disease|disease_protein|gene/protein' AS edge_type, hq.* FROM hq
    JOIN clean ON rel = 'disease_protein' AND src_id = disease AND dst_id = gene
  UNION ALL SELECT 'shortcut_drug_to_disease', 'drug|' || rel || '|disease', hq.* FROM hq
    JOIN clean ON src_type = 'drug' AND dst_type = 'disease' AND src_id = drug AND dst_id = disease) GROUP BY ALL""",
    ),
)
def residual_summary(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    every = pa.expand_to_quads(triplets(spark, sf_dir, "random").drop("split"), gr.gene_pathways(edges), distinct=True)
    return au.residual_summary(clean_edges(spark, sf_dir), every)


# texts that name the other end of some clinical pairs: each entity's text
# mentions its neighbours by indication
_TEXTS = """, texts AS (SELECT global_id, name, coalesce(t, '') AS text FROM nodes LEFT JOIN (
    SELECT d.drug AS global_id, string_agg(lower(n.name), ' and ' ORDER BY n.global_id) AS t FROM direct d JOIN nodes n ON n.global_id = d.disease WHERE rel = 'indication' GROUP BY d.drug
    UNION ALL SELECT d.disease, string_agg(upper(n.name), ' and ' ORDER BY n.global_id) FROM direct d JOIN nodes n ON n.global_id = d.drug WHERE rel = 'contraindication' GROUP BY d.disease) USING (global_id)),
  leaks AS (SELECT p.drug, p.disease, 'drug_text_contains_disease_name' AS direction, s.name AS matched, substr(d.text, 1, 300) AS preview
    FROM pairs p JOIN texts d ON d.global_id = p.drug JOIN texts s ON s.global_id = p.disease WHERE contains(lower(d.text), lower(s.name))
  UNION ALL SELECT p.drug, p.disease, 'disease_text_contains_drug_name', d.name, substr(s.text, 1, 300)
    FROM pairs p JOIN texts d ON d.global_id = p.drug JOIN texts s ON s.global_id = p.disease WHERE contains(lower(s.text), lower(d.name)))"""


def _entity_texts(spark, sf_dir):
    g = graph(spark, sf_dir)
    links = gr.direct_pairs(g.edges)

    def mentions(of: str, other: str, relation: str, form):
        names = g.nodes.select(F.col("global_id").alias(other), form("name").alias("_n"))
        listed = F.sort_array(F.collect_list(F.struct(other, "_n")))
        return (
            links.filter(F.col("rel") == relation).join(names, other)
            .groupBy(F.col(of).alias("global_id"))
            .agg(F.array_join(F.transform(listed, lambda s: s["_n"]), " and ").alias("text"))
        )

    texts = mentions("drug", "disease", "indication", F.lower).unionByName(
        mentions("disease", "drug", "contraindication", F.upper)
    )
    return g.nodes.select("global_id", "name").join(texts, "global_id", "left")


@query(
    "text_contamination",
    expect(("nodes", "direct", "pairs"), _TEXTS + " SELECT drug, disease, direction, matched, preview FROM leaks"),
)
def text_contamination(spark, sf_dir):
    pairs = gr.pair_relations(graph(spark, sf_dir).edges)
    return au.text_contamination(pairs, _entity_texts(spark, sf_dir))


@query(
    "contamination_summary",
    expect(
        ("nodes", "direct", "pairs"),
        _TEXTS + """ SELECT (SELECT count(*) FROM pairs) AS n_pairs, 2 * (SELECT count(*) FROM pairs) AS n_checks, count(*) AS n_leaks,
  round(count(*) / (2 * (SELECT count(*) FROM pairs)), 6) AS contamination_ratio FROM leaks""",
    ),
)
def contamination_summary(spark, sf_dir):
    pairs = gr.pair_relations(graph(spark, sf_dir).edges)
    return rounded(au.contamination_summary(pairs, _entity_texts(spark, sf_dir)), "contamination_ratio")


@query(
    "eval_degree",
    expect(
        ("split_random", "edges"),
        _ENDS.format(edges="edges")
        + """ SELECT 'disease' AS kind, count(DISTINCT disease) AS n_entities,
    round((SELECT count(*) FROM ends WHERE node_type = 'disease' AND node_id IN (SELECT disease FROM split_random WHERE split = 'test')) / count(DISTINCT disease), 6) AS mean_degree,
    round((SELECT count(*) FROM ends WHERE node_type = 'disease' AND src_type <> 'drug' AND node_id IN (SELECT disease FROM split_random WHERE split = 'test')) / count(DISTINCT disease), 6) AS mean_restricted_degree
  FROM split_random WHERE split = 'test'
  UNION ALL SELECT 'drug', count(DISTINCT drug),
    round((SELECT count(*) FROM ends WHERE node_type = 'drug' AND node_id IN (SELECT drug FROM split_random WHERE split = 'test')) / count(DISTINCT drug), 6),
    round((SELECT count(*) FROM ends WHERE node_type = 'drug' AND dst_type <> 'disease' AND node_id IN (SELECT drug FROM split_random WHERE split = 'test')) / count(DISTINCT drug), 6)
  FROM split_random WHERE split = 'test'""",
    ),
)
def eval_degree(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    test = splits(spark, sf_dir, "random").filter("split = 'test'")
    parts = [
        to.eval_entity_degree(test.select(F.col(c).alias("node_id")), t, edges).select(F.lit(c).alias("kind"), "*")
        for c, t in (("disease", DISEASE), ("drug", DRUG))
    ]
    return rounded(parts[0].unionByName(parts[1]), "mean_degree", "mean_restricted_degree")


@query(
    "hard_diseases",
    expect(
        ("split_cross_disease", "sg"),
        """ SELECT disease, count(gene) AS effective_degree FROM (SELECT DISTINCT disease FROM split_cross_disease WHERE split = 'test') LEFT JOIN sg USING (disease)
  GROUP BY disease ORDER BY 2, 1 LIMIT 25""",
    ),
)
def hard_diseases(spark, sf_dir):
    """The 25 test diseases with fewest links to genes."""
    test = splits(spark, sf_dir, "cross_disease").filter("split = 'test'").select("disease")
    return to.hardest_diseases(test, graph(spark, sf_dir).edges, 25)


@query(
    "audit_labels",
    expect(
        ("split_random", "nodes"),
        """, shifted AS (SELECT split, drug, disease + 1000000 * (drug % 2) AS disease FROM split_random WHERE split <> 'train')
  SELECT p.drug, p.disease, 'Drug: [' || coalesce(a.name, '<unknown:' || p.drug || '>') || '] | Disease: [' || coalesce(b.name, '<unknown:' || p.disease || '>') || ']' AS pair,
    CASE WHEN b.global_id IS NULL THEN 'id=' || p.disease ELSE 'name=' || b.name || ' | raw_id=' || b.raw_id || ' | node_type=' || b.node_type END AS entity
  FROM shifted p LEFT JOIN nodes a ON a.global_id = p.drug LEFT JOIN nodes b ON b.global_id = p.disease""",
    ),
)
def audit_labels(spark, sf_dir):
    """Held-out pairs as audits print them; the diseases of odd drugs are moved out of the graph."""
    nodes = graph(spark, sf_dir).nodes
    held = splits(spark, sf_dir, "random").filter("split <> 'train'").selectExpr("drug", "disease + 1000000 * (drug % 2) as disease")
    drugs = nodes.select(F.col("global_id").alias("_a"), F.col("name").alias("_an"))
    ends = nodes.select(F.col("global_id").alias("_b"), F.col("name").alias("_bn"), "raw_id", "node_type")
    joined = held.join(drugs, F.col("drug") == F.col("_a"), "left").join(ends, F.col("disease") == F.col("_b"), "left")
    return joined.select(
        "drug", "disease", pair_label(F.col("drug"), F.col("_an"), F.col("disease"), F.col("_bn")).alias("pair"),
        entity_label(F.col("_b").isNotNull(), F.col("_bn"), F.col("raw_id"), F.col("node_type"), F.col("disease")).alias("entity"),
    )
