"""Path, cleaning and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.graph import blank_pathway
from ..operators import graph as gr
from ..operators import paths as pa
from ..operators import splits as sp
from ..functions.keyed import key_hash
from .derived import FRACTIONS, clean_edges, splits, triplets
from .graph_store import graph
from .oracle import SEED, expect, h
from .registry import query

_RENAMED = "drug, gene, disease"


def _mode_names(mode: str) -> tuple[str, str]:
    return f"pt_{mode}", f"split_{mode}"


@query("pair_triplets", expect("pt_random", "SELECT split, drug, gene, disease FROM pt_random"))
def pair_triplets(spark, sf_dir):
    return pa.pair_triplets(graph(spark, sf_dir).edges, splits(spark, sf_dir, "random"))


@query(
    "capped_triplets",
    expect(
        ("dg", "sg"),
        """, d AS (SELECT drug, gene FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY drug) AS r FROM dg) WHERE r <= 12),
  s AS (SELECT disease, gene FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY disease) AS r FROM sg) WHERE r <= 12),
  t AS (SELECT * FROM d JOIN s USING (gene)),
  p AS (SELECT drug, disease FROM t GROUP BY ALL ORDER BY min(gene), drug, disease LIMIT 256)
  SELECT drug, gene, disease FROM (SELECT t.*, row_number() OVER (PARTITION BY drug, disease ORDER BY gene) AS r FROM t JOIN p USING (drug, disease)) WHERE r <= 4""",
    ),
)
def capped_triplets(spark, sf_dir):
    return pa.capped_triplets(graph(spark, sf_dir).edges)


@query("topology_paths", expect("triplets", f"SELECT {_RENAMED} FROM triplets"))
def topology_paths(spark, sf_dir):
    return pa.topology_paths(graph(spark, sf_dir).edges)


@query("gene_pathways", expect("gp", "SELECT gene, pathway FROM gp"))
def gene_pathways(spark, sf_dir):
    return gr.gene_pathways(graph(spark, sf_dir).edges)


@query(
    "quads",
    expect(
        ("pt_random", "gp"),
        "SELECT drug, gene, coalesce(pathway, 0) AS pathway, disease, split, pathway IS NULL AS is_dummy FROM pt_random LEFT JOIN gp USING (gene)",
    ),
)
def quads(spark, sf_dir):
    expanded = pa.expand_to_quads(triplets(spark, sf_dir, "random"), gr.gene_pathways(graph(spark, sf_dir).edges))
    return pa.mark_dummy(expanded)


@query("real_quads", expect("quads", "SELECT drug, gene, pathway, disease FROM quads"))
def real_quads(spark, sf_dir):
    return pa.real_quads(graph(spark, sf_dir).edges)


@query("blank_pathways", expect("quads", "SELECT drug, gene, 0 AS pathway, disease, count(*) AS n FROM quads GROUP BY ALL"))
def blank_pathways(spark, sf_dir):
    hidden = blank_pathway(pa.real_quads(graph(spark, sf_dir).edges))
    return hidden.groupBy("drug", "gene", "pathway", "disease").agg(F.count("*").alias("n"))


def _banks(spark, sf_dir):
    """Train and test triplets as positives; test and ot triplets over a gene with a pathway as external."""
    every = triplets(spark, sf_dir, "random")
    own = every.filter("split in ('train', 'test')").select("drug", "gene", "disease")
    late = every.filter("split in ('test', 'ot')")
    external = late.join(gr.gene_pathways(graph(spark, sf_dir).edges), "gene", "left_semi")
    return own, external.select("drug", "gene", "disease")


_BANKS = """, own AS (SELECT drug, gene, disease FROM pt_random WHERE split IN ('train', 'test')),
  ext AS (SELECT drug, gene, disease FROM pt_random WHERE split IN ('test', 'ot') AND gene IN (SELECT gene FROM gp))"""


@query(
    "path_bank",
    expect(("pt_random", "gp"), _BANKS + """ SELECT * FROM ext UNION ALL
  SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM ext e WHERE e.drug = o.drug AND e.disease = o.disease)"""),
)
def path_bank(spark, sf_dir):
    return pa.positive_bank(*_banks(spark, sf_dir))


@query(
    "topology_bank",
    expect(("pt_random", "triplets", "gp"), _BANKS + " SELECT drug, gene, disease FROM triplets UNION SELECT * FROM ext"),
)
def topology_bank(spark, sf_dir):
    return pa.topology_bank(pa.topology_paths(graph(spark, sf_dir).edges), _banks(spark, sf_dir)[1])


@query(
    "nested_paths",
    expect(
        "quads",
        """SELECT drug, disease, count(*) AS n_paths, string_agg(gene || ':' || pathway, ',' ORDER BY gene, pathway) AS paths FROM quads GROUP BY drug, disease""",
    ),
)
def nested_paths(spark, sf_dir):
    nested = pa.nested_paths(pa.real_quads(graph(spark, sf_dir).edges))
    flat = F.array_join(F.transform("paths", lambda p: F.concat_ws(":", p["gene"], p["pathway"])), ",")
    return nested.withColumn("paths", flat)


@query(
    "nested_path_chunks",
    expect(
        "quads",
        """SELECT drug, disease, chunk, string_agg(gene || ':' || pathway, ',' ORDER BY gene, pathway) AS paths FROM (
  SELECT *, floor((row_number() OVER (PARTITION BY drug, disease ORDER BY gene, pathway) - 1) / 3)::BIGINT AS chunk FROM quads) GROUP BY drug, disease, chunk""",
    ),
)
def nested_path_chunks(spark, sf_dir):
    """Mechanisms of each pair, three to a row."""
    chunks = pa.nested_path_chunks(pa.real_quads(graph(spark, sf_dir).edges), 3)
    return chunks.withColumn("paths", F.array_join(F.transform("paths", lambda p: F.concat_ws(":", p["gene"], p["pathway"])), ","))


@query("connected_pairs", expect("connected", "SELECT drug, disease FROM connected"))
def connected_pairs(spark, sf_dir):
    return pa.connected_pairs(graph(spark, sf_dir).edges)


@query(
    "known_pairs",
    expect(("triplets", "direct"), "SELECT drug, disease FROM triplets UNION SELECT drug, disease FROM direct"),
)
def known_pairs(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    return pa.known_positive_pairs(pa.topology_paths(edges), edges)


@query("shared_genes", expect(("pairs", "triplets"), "SELECT drug, disease, gene FROM pairs JOIN triplets USING (drug, disease)"))
def shared_genes(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    pairs = gr.pair_relations(edges).select("drug", "disease")
    return pa.shared_genes(pairs, gr.drug_gene(edges), gr.disease_gene(edges))


@query(
    "first_paths",
    expect(
        ("pairs", "quads"),
        """SELECT drug, disease, coalesce(gene, 0) AS gene, coalesce(pathway, 0) AS pathway, gene IS NOT NULL AS has_path FROM (SELECT drug, disease FROM pairs)
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY drug, disease ORDER BY gene, pathway) AS r FROM quads) WHERE r = 1) USING (drug, disease)""",
    ),
)
def first_paths(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    pairs = gr.pair_relations(edges).select("drug", "disease")
    shared = pa.shared_genes(pairs, gr.drug_gene(edges), gr.disease_gene(edges))
    return pa.first_path_per_pair(pairs, pa.expand_to_quads(shared, gr.gene_pathways(edges)))


@query(
    "target_subset",
    expect(
        ("pt_cross_drug", "gp"),
        "SELECT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM pt_cross_drug LEFT JOIN gp USING (gene) WHERE split IN ('valid', 'test')",
    ),
)
def target_subset(spark, sf_dir):
    held = pa.target_subset(triplets(spark, sf_dir, "cross_drug"), "heldout")
    return pa.expand_to_quads(held, gr.gene_pathways(graph(spark, sf_dir).edges), distinct=True)


# --- splits ---


@query("pair_relations", expect("pairs", "SELECT drug, disease, relations FROM pairs"))
def pair_relations(spark, sf_dir):
    return gr.pair_relations(graph(spark, sf_dir).edges).withColumn("relations", F.array_join("relations", ","))


def _split(mode: str):
    @query(f"split_{mode}", expect(f"split_{mode}", f"SELECT split, drug, disease FROM split_{mode}"))
    def run(spark, sf_dir):
        pairs = gr.pair_relations(graph(spark, sf_dir).edges)
        return sp.make_split(pairs, mode, FRACTIONS, SEED).select("split", "drug", "disease")

    return run


for _mode in ("random", "cross_drug", "cross_disease"):
    _split(_mode)


@query(
    "split_triplets",
    expect(
        "triplets",
        f"""SELECT drug, gene, disease, CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY {h(7, 'drug', 'gene', 'disease')}, drug, gene, disease) - 1 AS rn, count(*) OVER () AS n FROM triplets)""",
    ),
)
def split_triplets(spark, sf_dir):
    return sp.split_triplets(pa.topology_paths(graph(spark, sf_dir).edges), seed=7)


@query(
    "entity_splits",
    expect("split_cross_disease", "SELECT DISTINCT split, disease AS entity FROM split_cross_disease"),
)
def entity_splits(spark, sf_dir):
    return sp.entity_splits(splits(spark, sf_dir, "cross_disease"), "disease")


@query(
    "negative_pools",
    expect(
        ("split_cross_drug", "split_cross_disease"),
        """SELECT DISTINCT 'drug' AS pool, drug AS entity FROM split_cross_drug WHERE split = 'train'
  UNION ALL SELECT DISTINCT 'disease', disease FROM split_cross_disease WHERE split = 'train'""",
    ),
)
def negative_pools(spark, sf_dir):
    drugs, _ = sp.negative_pools("cross_drug", splits(spark, sf_dir, "cross_drug"))
    _, diseases = sp.negative_pools("cross_disease", splits(spark, sf_dir, "cross_disease"))
    return drugs.select(F.lit("drug").alias("pool"), F.col("drug").alias("entity")).unionByName(
        diseases.select(F.lit("disease").alias("pool"), F.col("disease").alias("entity"))
    )


@query(
    "disjoint_violations",
    expect(
        "split_random",
        "SELECT drug, count(DISTINCT split) AS n_splits FROM split_random GROUP BY drug HAVING count(DISTINCT split) > 1",
    ),
)
def disjoint_violations(spark, sf_dir):
    return sp.disjoint_violations(splits(spark, sf_dir, "random"), ["drug"])


@query(
    "split_summary",
    expect(
        "pt_cross_disease",
        "SELECT split, count(*) AS n_triplets, count(DISTINCT (drug, disease)) AS n_pairs FROM pt_cross_disease GROUP BY split",
    ),
)
def split_summary(spark, sf_dir):
    return sp.split_summary(triplets(spark, sf_dir, "cross_disease"))


@query(
    "sampled_pairs",
    expect("pairs", f"SELECT drug, disease FROM pairs ORDER BY {h(3, 'drug', 'disease')}, drug, disease LIMIT 100"),
)
def sampled_pairs(spark, sf_dir):
    pairs = gr.pair_relations(graph(spark, sf_dir).edges).select("drug", "disease")
    return sp.sample_k(pairs, ["drug", "disease"], 100, 3)


# --- cleaning ---

_EDGES = "src_id, src_type, rel, dst_type, dst_id"


@query(
    "holdout_pairs",
    expect(
        ("split_cross_disease", "pt_cross_disease"),
        """SELECT drug, disease FROM split_cross_disease WHERE split IN ('valid', 'test', 'ot')
  UNION SELECT drug, disease FROM pt_cross_disease WHERE split IN ('valid', 'test')""",
    ),
)
def holdout_pairs(spark, sf_dir):
    held = pa.target_subset(triplets(spark, sf_dir, "cross_disease"), "heldout")
    return gr.collect_holdout_pairs(splits(spark, sf_dir, "cross_disease"), paths=held)


@query("direct_clean", expect("clean", f"SELECT {_EDGES} FROM clean"))
def direct_clean(spark, sf_dir):
    return clean_edges(spark, sf_dir)


@query(
    "direct_clean_typed",
    expect(
        ("edges", "holdout"),
        f"""SELECT {_EDGES} FROM edges e WHERE NOT (src_type = 'drug' AND rel = 'indication'
  AND EXISTS (SELECT 1 FROM holdout x WHERE x.drug = e.src_id AND x.disease = e.dst_id))""",
    ),
)
def direct_clean_typed(spark, sf_dir):
    held = gr.collect_holdout_pairs(splits(spark, sf_dir, "cross_disease"))
    return gr.remove_direct_edges(graph(spark, sf_dir).edges, held, [("drug", "indication", "disease")])


def _path_clean(pathway_rule: str) -> str:
    return f""", held AS (SELECT DISTINCT drug, gene, disease FROM pt_random WHERE split IN ('valid', 'test')),
  hq AS (SELECT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM held LEFT JOIN gp USING (gene))
  SELECT {_EDGES} FROM edges e WHERE NOT (
    (rel = 'targets' AND EXISTS (SELECT 1 FROM held x WHERE x.drug = src_id AND x.gene = dst_id))
    OR (rel = 'disease_protein' AND EXISTS (SELECT 1 FROM held x WHERE x.disease = src_id AND x.gene = dst_id))
    OR (src_type = 'drug' AND dst_type = 'disease' AND EXISTS (SELECT 1 FROM held x WHERE x.drug = src_id AND x.disease = dst_id))
    OR (rel = 'in_pathway' AND EXISTS ({pathway_rule})))"""


@query(
    "path_clean_triplet",
    expect(("edges", "pt_random", "gp"), _path_clean("SELECT 1 FROM held x WHERE x.gene = src_id")),
)
def path_clean_triplet(spark, sf_dir):
    held = pa.target_subset(triplets(spark, sf_dir, "random"), "heldout")
    return gr.remove_path_edges(graph(spark, sf_dir).edges, held)


@query(
    "path_clean_quad",
    expect(("edges", "pt_random", "gp"), _path_clean("SELECT 1 FROM hq x WHERE x.gene = src_id AND x.pathway = dst_id")),
)
def path_clean_quad(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    held = pa.target_subset(triplets(spark, sf_dir, "random"), "heldout")
    return gr.remove_path_edges(edges, pa.expand_to_quads(held, gr.gene_pathways(edges)))


@query(
    "isolate",
    expect(
        ("edges", "split_cross_drug"),
        f"""SELECT {_EDGES} FROM edges WHERE NOT (src_type = 'drug' AND src_id IN (SELECT drug FROM split_cross_drug WHERE split IN ('valid', 'test')))""",
    ),
)
def isolate(spark, sf_dir):
    targets = gr.isolation_targets("cross_drug", splits(spark, sf_dir, "cross_drug"))
    return gr.isolate_nodes(graph(spark, sf_dir).edges, targets)


@query(
    "batch_masked",
    expect(
        ("direct", "split_random"),
        f"""SELECT b.batch_id, drug AS src_id, 'drug' AS src_type, rel, 'disease' AS dst_type, disease AS dst_id
  FROM direct JOIN (SELECT drug, disease, {h('batch', 'drug', 'disease')} % 64 AS batch_id FROM split_random WHERE split = 'train') b USING (drug, disease)""",
    ),
)
def batch_masked(spark, sf_dir):
    train = splits(spark, sf_dir, "random").filter("split = 'train'")
    batches = train.select(F.pmod(key_hash("batch", "drug", "disease"), F.lit(64)).alias("batch_id"), "drug", "disease")
    return gr.masked_batch_edges(graph(spark, sf_dir).edges, batches)


_DELETIONS = """SELECT src_type, rel, dst_type, CASE WHEN src_type = 'drug' AND dst_type = 'disease' THEN 'direct_leakage' ELSE 'mechanistic' END AS category,
  n_before, n_after, n_before - n_after AS n_deleted, round((n_before - n_after)::DOUBLE / n_before, 9) AS deleted_ratio
  FROM (SELECT src_type, rel, dst_type, count(*) AS n_before FROM edges GROUP BY ALL)
  JOIN (SELECT src_type, rel, dst_type, count(*) AS n_after FROM clean GROUP BY ALL) USING (src_type, rel, dst_type) WHERE n_before > n_after"""


@query("deletions", expect(("edges", "clean"), _DELETIONS))
def deletions(spark, sf_dir):
    report = gr.deletion_report(graph(spark, sf_dir).edges, clean_edges(spark, sf_dir))
    return gr.order_deletions(report.withColumn("deleted_ratio", F.round("deleted_ratio", 9)))


@query(
    "deletion_totals",
    expect(
        ("edges", "clean"),
        f"SELECT category, sum(n_deleted)::BIGINT AS n_deleted, sum(n_before)::BIGINT AS n_before FROM ({_DELETIONS}) GROUP BY ROLLUP (category)",
    ),
)
def deletion_totals(spark, sf_dir):
    return gr.deletion_totals(gr.deletion_report(graph(spark, sf_dir).edges, clean_edges(spark, sf_dir)))
