"""Negative sampling, corruption and graph-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import key_hash
from ..lineage import materialize
from ..operators import audits as au
from ..operators import graph as gr
from ..operators import paths as pa
from ..operators import sampling as sa
from ..operators import splits as sp
from ..operators import topology as tp
from ..schema import DISEASE, DRUG, GENE
from .audit_queries import rounded
from .derived import connected, links, splits, triplets
from .graph_store import graph, table
from .oracle import SEED, expect, h
from .registry import query


def node_ids(spark, sf_dir, node_type: str, name: str):
    return graph(spark, sf_dir).nodes.filter(F.col("node_type") == node_type).select(F.col("global_id").alias(name))


# --- negatives of pairs ---

_POSITIVES = """, pos AS (SELECT DISTINCT drug, disease FROM pt_random),
  known AS (SELECT drug, disease FROM pairs),
  valid AS (SELECT drug, disease FROM connected EXCEPT SELECT drug, disease FROM known)"""

_LINKED = {
    **{
        f"cross_{free}": f"""SELECT p.drug, p.disease, q.drug AS neg_drug, q.disease AS neg_disease
    FROM (SELECT pos.*, {h(f'{SEED}:cross_{free}', 'pos.drug', 'pos.disease')} % n AS i FROM pos JOIN (SELECT {fixed}, count(*) AS n FROM valid GROUP BY {fixed}) USING ({fixed})) p
    JOIN (SELECT *, row_number() OVER (PARTITION BY {fixed} ORDER BY {h(SEED, free)}, {free}) - 1 AS i FROM valid) q ON q.{fixed} = p.{fixed} AND q.i = p.i"""
        for free, fixed in (("drug", "disease"), ("disease", "drug"))
    },
    "random": f"""SELECT p.drug, p.disease, q.drug AS neg_drug, q.disease AS neg_disease
    FROM (SELECT *, {h(f'{SEED}:random', 'drug', 'disease')} % (SELECT count(*) FROM valid) AS i FROM pos) p
    JOIN (SELECT *, row_number() OVER (ORDER BY {h(SEED, 'drug', 'disease')}, drug, disease) - 1 AS i FROM valid) q ON q.i = p.i""",
}
_PICKS = ", " + ", ".join(f"pick_{k} AS ({v})" for k, v in _LINKED.items())

_CHOICES = {
    "random": "SELECT *, 'random' AS used FROM pick_random",
    "cross_drug": """SELECT p.drug, p.disease, coalesce(a.neg_drug, r.neg_drug) AS neg_drug, coalesce(a.neg_disease, r.neg_disease) AS neg_disease,
    CASE WHEN a.drug IS NULL THEN 'random' ELSE 'cross_drug' END AS used FROM pos p LEFT JOIN pick_cross_drug a USING (drug, disease) LEFT JOIN pick_random r USING (drug, disease)""",
    "cross_disease": """SELECT p.drug, p.disease, coalesce(a.neg_drug, r.neg_drug) AS neg_drug, coalesce(a.neg_disease, r.neg_disease) AS neg_disease,
    CASE WHEN a.drug IS NULL THEN 'random' ELSE 'cross_disease' END AS used FROM pos p LEFT JOIN pick_cross_disease a USING (drug, disease) LEFT JOIN pick_random r USING (drug, disease)""",
    "mixed": f"""SELECT drug, disease, neg_drug, neg_disease, used FROM (
    SELECT p.drug, p.disease, neg_drug, neg_disease, used, row_number() OVER (PARTITION BY p.drug, p.disease ORDER BY k <> {h(f'{SEED}:mixed', 'p.drug', 'p.disease')} % 3, k) AS r FROM pos p JOIN (
      SELECT *, 0 AS k, 'cross_drug' AS used FROM pick_cross_drug UNION ALL SELECT *, 1, 'cross_disease' FROM pick_cross_disease UNION ALL SELECT *, 2, 'random' FROM pick_random) USING (drug, disease)) WHERE r = 1""",
}
_NEG_BASE = ("pt_random", "pairs", "connected")


def negatives_sql(strategy: str) -> str:
    return _POSITIVES + _PICKS + f", neg AS ({_CHOICES[strategy]})"


def negatives(spark, sf_dir, strategy: str, **pools):
    edges = graph(spark, sf_dir).edges
    positives = triplets(spark, sf_dir, "random").select("drug", "disease")
    return sa.negative_pairs(
        positives,
        connected(spark, sf_dir),
        pa.known_positive_pairs(positives, edges),
        node_ids(spark, sf_dir, DRUG, "drug"),
        node_ids(spark, sf_dir, DISEASE, "disease"),
        strategy,
        SEED,
        **pools,
    )


def _negatives_query(strategy: str):
    sql = expect(_NEG_BASE, negatives_sql(strategy) + " SELECT drug, disease, neg_drug, neg_disease, used FROM neg")

    @query(f"negatives_{strategy}", sql)
    def run(spark, sf_dir):
        return negatives(spark, sf_dir, strategy)

    return run


for _strategy in _CHOICES:
    _negatives_query(_strategy)


def _pool_sql(free: str, fixed: str) -> str:
    """Draws of one end from the train entities of its split: connected candidates, then tries in the pool, then its k-th free entity."""
    used = f"cross_{free}"
    return _POSITIVES + f""", allowed AS (SELECT DISTINCT {free} FROM split_{used} WHERE split = 'train'),
  lp AS (SELECT *, row_number() OVER (PARTITION BY {fixed} ORDER BY {h(SEED, free)}, {free}) - 1 AS i, count(*) OVER (PARTITION BY {fixed}) AS n FROM valid WHERE {free} IN (SELECT {free} FROM allowed)),
  linked AS (SELECT p.drug, p.disease, q.{free} AS neg FROM pos p JOIN lp q ON q.{fixed} = p.{fixed} AND i = {h(f'{SEED}:{used}', 'p.drug', 'p.disease')} % n),
  left_over AS (SELECT * FROM pos p WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.drug = p.drug AND l.disease = p.disease)),
  pool AS (SELECT {free} AS neg, row_number() OVER (ORDER BY {h(SEED, free)}, {free}) - 1 AS i, count(*) OVER () AS n FROM allowed),
  tries AS (SELECT l.drug, l.disease, k, p.neg FROM left_over l, range(8) t(k), pool p WHERE p.i = {h(f'{SEED}:pool:{used}', 'l.drug', 'l.disease', 'k')} % p.n
    AND NOT EXISTS (SELECT 1 FROM known x WHERE x.{free} = p.neg AND x.{fixed} = l.{fixed})),
  drawn AS (SELECT drug, disease, arg_min(neg, k) AS neg FROM tries GROUP BY ALL),
  rest AS (SELECT drug, disease, neg FROM (
      SELECT l.drug, l.disease, p.neg, row_number() OVER (PARTITION BY l.drug, l.disease ORDER BY p.i) - 1 AS r, count(*) OVER (PARTITION BY l.drug, l.disease) AS c
      FROM left_over l, pool p WHERE NOT EXISTS (SELECT 1 FROM drawn d WHERE d.drug = l.drug AND d.disease = l.disease)
        AND NOT EXISTS (SELECT 1 FROM known x WHERE x.{free} = p.neg AND x.{fixed} = l.{fixed}))
    WHERE r = {h(f'{SEED}:pool:{used}:rest', 'drug', 'disease')} % c)
  SELECT drug, disease, neg AS neg_{free}, {fixed} AS neg_{fixed}, '{used}' AS used FROM (SELECT * FROM linked UNION ALL SELECT * FROM drawn UNION ALL SELECT * FROM rest)"""


@query("negatives_pool", expect((*_NEG_BASE, "split_cross_drug", "nodes"), _pool_sql("drug", "disease")))
def negatives_pool(spark, sf_dir):
    pool, _ = sp.negative_pools("cross_drug", splits(spark, sf_dir, "cross_drug"))
    sa.validate_pool(pool, node_ids(spark, sf_dir, DRUG, "drug"))
    return negatives(spark, sf_dir, "cross_drug", drug_pool=pool)


@query("negatives_pool_disease", expect((*_NEG_BASE, "split_cross_disease", "nodes"), _pool_sql("disease", "drug")))
def negatives_pool_disease(spark, sf_dir):
    _, pool = sp.negative_pools("cross_disease", splits(spark, sf_dir, "cross_disease"))
    sa.validate_pool(pool, node_ids(spark, sf_dir, DISEASE, "disease"))
    return negatives(spark, sf_dir, "cross_disease", disease_pool=pool)


def _numbered_sql(name: str, source: str, column: str) -> str:
    return f"{name} AS (SELECT {column} AS v, row_number() OVER (ORDER BY {h(SEED, column)}, {column}) - 1 AS i, count(*) OVER () AS n FROM {source})"


@query(
    "negatives_pool_random",
    expect(
        (*_NEG_BASE, "split_cross_drug", "nodes"),
        _POSITIVES
        + f""", {_numbered_sql('dp', "(SELECT DISTINCT drug FROM split_cross_drug WHERE split = 'train')", 'drug')},
  {_numbered_sql('sp', "(SELECT global_id AS disease FROM nodes WHERE node_type = 'disease')", 'disease')},
  tries AS (SELECT p.drug, p.disease, k, d.v AS neg_drug, s.v AS neg_disease
    FROM (SELECT *, {h(f'{SEED}:pool:drug', 'drug', 'disease', 'k')} % (SELECT count(*) FROM dp) AS a, {h(f'{SEED}:pool:disease', 'drug', 'disease', 'k')} % (SELECT count(*) FROM sp) AS b
      FROM pos, range(8) t(k)) p JOIN dp d ON d.i = a JOIN sp s ON s.i = b
    WHERE NOT EXISTS (SELECT 1 FROM known x WHERE x.drug = d.v AND x.disease = s.v)),
  drawn AS (SELECT drug, disease, arg_min((neg_drug, neg_disease), k) AS x FROM tries GROUP BY ALL),
  free AS (SELECT d.v AS neg_drug, s.v AS neg_disease, row_number() OVER (ORDER BY d.i, s.i) - 1 AS r, count(*) OVER () AS c FROM dp d, sp s
    WHERE EXISTS (SELECT 1 FROM pos p WHERE NOT EXISTS (SELECT 1 FROM drawn w WHERE w.drug = p.drug AND w.disease = p.disease))
      AND NOT EXISTS (SELECT 1 FROM known x WHERE x.drug = d.v AND x.disease = s.v)),
  rest AS (SELECT p.drug, p.disease, neg_drug, neg_disease FROM pos p, free WHERE NOT EXISTS (SELECT 1 FROM drawn w WHERE w.drug = p.drug AND w.disease = p.disease)
    AND r = {h(f'{SEED}:pool:rest', 'p.drug', 'p.disease')} % c)
  SELECT drug, disease, x[1] AS neg_drug, x[2] AS neg_disease, 'random' AS used FROM drawn UNION ALL SELECT *, 'random' FROM rest""",
    ),
)
def negatives_pool_random(spark, sf_dir):
    """Any train drug with any disease, whatever the topology."""
    pool, _ = sp.negative_pools("cross_drug", splits(spark, sf_dir, "cross_drug"))
    return negatives(spark, sf_dir, "random", drug_pool=pool)


@query(
    "negative_genes",
    expect(
        ("pt_random", "nodes"),
        f""", pool AS (SELECT global_id AS neg_gene, row_number() OVER (ORDER BY {h(SEED, 'global_id')}, global_id) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE node_type = 'gene/protein'),
  paths AS (SELECT DISTINCT drug, gene, disease FROM pt_random),
  tries AS (SELECT t.drug, t.gene, t.disease, k, p.neg_gene
    FROM (SELECT *, {h(f'{SEED}:gene', 'drug', 'gene', 'disease', 'k')} % (SELECT count(*) FROM pool) AS i FROM paths, range(8) r(k)) t JOIN pool p ON p.i = t.i
    WHERE NOT EXISTS (SELECT 1 FROM paths x WHERE x.drug = t.drug AND x.disease = t.disease AND x.gene = p.neg_gene))
  SELECT drug, gene, disease, arg_min(neg_gene, k) AS neg_gene FROM tries GROUP BY ALL""",
    ),
)
def negative_genes(spark, sf_dir):
    paths = triplets(spark, sf_dir, "random").select("drug", "gene", "disease")
    return sa.negative_genes(paths, node_ids(spark, sf_dir, GENE, "gene"), SEED)


# genes of the pair that has most of them (ties: smallest ids)
_TIGHT = """, paths AS (SELECT DISTINCT drug, gene, disease FROM pt_random),
  widest AS (SELECT drug, disease FROM paths GROUP BY ALL ORDER BY count(*) DESC, drug, disease LIMIT 1),
  pool AS (SELECT gene AS neg_gene FROM paths JOIN widest USING (drug, disease))"""


@query(
    "unresolved_negatives",
    expect(
        "pt_random",
        _TIGHT
        + """ SELECT drug, gene, disease FROM paths t WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE NOT EXISTS (
    SELECT 1 FROM paths x WHERE x.drug = t.drug AND x.disease = t.disease AND x.gene = p.neg_gene))""",
    ),
)
def unresolved_negatives(spark, sf_dir):
    """Paths for which the genes of the pair with most genes leave no negative gene: those of that pair at least."""
    paths = triplets(spark, sf_dir, "random").select("drug", "gene", "disease").distinct()
    sizes = paths.groupBy("drug", "disease").agg(F.count("*").alias("n"))
    widest = F.max_by(F.struct("drug", "disease"), F.struct("n", -F.col("drug"), -F.col("disease"))).alias("w")
    genes = paths.join(sizes.agg(widest).select("w.*"), ["drug", "disease"]).select("gene")
    return sa.unresolved(paths, sa.negative_genes(paths, genes, SEED, on_missing="drop"), ["drug", "gene", "disease"])


_AT = {
    0: ("-1", "gene", "pathway", "disease", "drug"),
    1: ("drug", "-1", "pathway", "disease", "gene"),
    2: ("drug", "gene", "-1", "disease", "pathway"),
    3: ("drug", "gene", "pathway", "-1", "disease"),
}


def _at(source: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, {d} AS at_drug, {g} AS at_gene, {p} AS at_pathway, {s} AS at_disease, {v} AS {value} FROM {source}"
        for i, (d, g, p, s, v) in _AT.items()
    )


_CTX = "position, at_drug, at_gene, at_pathway, at_disease"
_SAME = " AND ".join(f"x.{c} = r.{c}" for c in _CTX.split(", "))


@query(
    "corrupt_paths",
    expect(
        ("pt_random", "gp", "quads", "nodes"),
        f""", pos AS (SELECT DISTINCT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM pt_random LEFT JOIN gp USING (gene)),
  pool AS (SELECT position, global_id AS value, row_number() OVER (PARTITION BY position ORDER BY {h(SEED, 'global_id')}, global_id) - 1 AS i, count(*) OVER (PARTITION BY position) AS n
    FROM (SELECT global_id, CASE node_type WHEN 'drug' THEN 0 WHEN 'gene/protein' THEN 1 WHEN 'pathway' THEN 2 ELSE 3 END AS position FROM nodes)),
  taken AS ({_at('quads', 'value')}),
  req AS ({_at('pos', 'cur')}),
  tries AS (SELECT r.*, k, p.value FROM (SELECT *, {h(f'{SEED}:corrupt', 'position', 'at_drug', 'at_gene', 'at_pathway', 'at_disease', 'cur', 'k')} AS hh FROM req, range(4) t(k)) r
    JOIN pool p ON p.position = r.position AND p.i = hh % p.n WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE {_SAME} AND x.value = p.value)),
  drawn AS (SELECT {_CTX}, cur, arg_min(value, k) AS value FROM tries GROUP BY ALL),
  left_over AS (SELECT {_CTX}, cur FROM req EXCEPT SELECT {_CTX}, cur FROM drawn),
  rest AS (SELECT {_CTX}, cur, value FROM (
      SELECT r.*, p.value, row_number() OVER (PARTITION BY {_CTX.replace("position", "r.position")}, cur ORDER BY p.i) - 1 AS z,
             count(*) OVER (PARTITION BY {_CTX.replace("position", "r.position")}, cur) AS c
      FROM left_over r JOIN pool p ON p.position = r.position WHERE NOT EXISTS (SELECT 1 FROM taken x WHERE {_SAME} AND x.value = p.value))
    WHERE z = {h(f'{SEED}:corrupt:rest', 'position', 'at_drug', 'at_gene', 'at_pathway', 'at_disease', 'cur')} % c),
  negs AS (SELECT * FROM drawn UNION ALL SELECT * FROM rest)
  SELECT drug AS pos_drug, gene AS pos_gene, pathway AS pos_pathway, disease AS pos_disease, 0 AS candidate_idx, 1 AS label, drug, gene, pathway, disease FROM pos
  UNION ALL SELECT CASE position WHEN 0 THEN cur ELSE at_drug END, CASE position WHEN 1 THEN cur ELSE at_gene END, CASE position WHEN 2 THEN cur ELSE at_pathway END, CASE position WHEN 3 THEN cur ELSE at_disease END,
    position + 1, 0, CASE position WHEN 0 THEN value ELSE at_drug END, CASE position WHEN 1 THEN value ELSE at_gene END, CASE position WHEN 2 THEN value ELSE at_pathway END, CASE position WHEN 3 THEN value ELSE at_disease END FROM negs""",
    ),
)
def corrupt_paths(spark, sf_dir):
    g = graph(spark, sf_dir)
    positives = pa.expand_to_quads(triplets(spark, sf_dir, "random").drop("split"), gr.gene_pathways(g.edges))
    # where a gene is linked to every drug, say, that position has no corruption
    return sa.corrupt_paths(positives, g.nodes, None, SEED, edges=g.edges, on_missing="drop")


# --- graph views ---


@query(
    "dropedge",
    expect(
        "edges",
        f"""SELECT src_id, src_type, rel, dst_type, dst_id FROM edges WHERE {h(5, 'src_type', 'rel', 'dst_type', 'src_id', 'dst_id')}::DOUBLE / 1152921504606846976::DOUBLE > 0.2::DOUBLE""",
    ),
)
def dropedge(spark, sf_dir):
    return sa.drop_edges(graph(spark, sf_dir).edges, 0.2, 5)


@query(
    "mask_features",
    f"""SELECT vec_id AS key, CASE WHEN {h(5, 'vec_id')}::DOUBLE / 1152921504606846976::DOUBLE < 0.3::DOUBLE THEN 0 ELSE round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) END AS mass FROM embeddings""",
)
def mask_features(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    masked = sa.mask_features(vectors, 0.3, 5, 64)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    return masked.select("key", F.round(total, 6).alias("mass"))


@query(
    "sample_nodes",
    expect("nodes", f"SELECT global_id, node_type, raw_id FROM nodes WHERE node_type = 'disease' ORDER BY {h(9, 'global_id')}, global_id LIMIT 64"),
)
def sample_nodes(spark, sf_dir):
    return sa.sample_nodes(graph(spark, sf_dir).nodes, DISEASE, 64, 9).select("global_id", "node_type", "raw_id")


# --- audits of sampled negatives ---


@query(
    "negative_collisions",
    expect(
        (*_NEG_BASE, "direct"),
        negatives_sql("mixed")
        + """ SELECT rel, count(*) AS n_relation_pairs, count(x.neg_drug) AS n_overlaps, rel = 'indication' AND count(x.neg_drug) > 0 AS is_hard_failure
  FROM direct d LEFT JOIN (SELECT DISTINCT neg_drug, neg_disease FROM neg) x ON x.neg_drug = d.drug AND x.neg_disease = d.disease GROUP BY rel""",
    ),
)
def negative_collisions(spark, sf_dir):
    return au.negative_collisions(negatives(spark, sf_dir, "mixed"), graph(spark, sf_dir).edges)


@query(
    "negative_tail_types",
    expect(
        (*_NEG_BASE, "nodes"),
        negatives_sql("cross_disease")
        + " SELECT node_type, count(*) AS n_negatives, bool_and(node_type = 'disease') AS is_valid FROM neg JOIN nodes ON global_id = neg_disease GROUP BY node_type",
    ),
)
def negative_tail_types(spark, sf_dir):
    return au.negative_tail_types(negatives(spark, sf_dir, "cross_disease"), graph(spark, sf_dir).nodes)


_SPLIT_NEG = """, sn AS (SELECT s.drug, s.disease, s.split, q.drug AS neg_drug, q.disease AS neg_disease FROM split_random s
    JOIN (SELECT *, row_number() OVER (ORDER BY {order}, drug, disease) - 1 AS i, count(*) OVER () AS n FROM (SELECT drug, disease FROM connected EXCEPT SELECT drug, disease FROM pairs)) q
      ON i = {pick} % n)""".format(order=h(SEED, "drug", "disease"), pick=h(f"{SEED}:random", "s.drug", "s.disease"))


def split_negatives(spark, sf_dir):
    """Random topology negatives of every split pair."""
    every = splits(spark, sf_dir, "random")
    drawn = sa.negative_pairs(
        every, connected(spark, sf_dir), every,
        node_ids(spark, sf_dir, DRUG, "drug"), node_ids(spark, sf_dir, DISEASE, "disease"), "random", SEED,
    )
    return every.join(drawn, ["drug", "disease"])


@query(
    "dummy_ratio",
    expect(
        ("split_random", "connected", "pairs", "quads"),
        _SPLIT_NEG
        + """ SELECT count(*) FILTER (WHERE pathway = 0) AS n_dummy, count(*) AS n_paths, round(count(*) FILTER (WHERE pathway = 0) / count(*), 6) AS dummy_ratio
  FROM (SELECT neg_drug AS drug, neg_disease AS disease FROM sn) JOIN quads USING (drug, disease)""",
    ),
)
def dummy_ratio(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    negs = split_negatives(spark, sf_dir).select(F.col("neg_drug").alias("drug"), F.col("neg_disease").alias("disease"))
    negs = materialize(negs, "negatives")
    shared = pa.shared_genes(negs, gr.drug_gene(edges), gr.disease_gene(edges))
    return rounded(sa.dummy_ratio(pa.expand_to_quads(shared, gr.gene_pathways(edges))), "dummy_ratio")


@query(
    "empty_path_ratio",
    expect(
        ("split_random", "connected", "pairs", "quads"),
        _SPLIT_NEG
        + f""", qc AS (SELECT drug, disease, count(*) AS n FROM quads GROUP BY ALL)
  SELECT batch, count(*) AS n_pairs, count(*) FILTER (WHERE p.n IS NULL) AS pos_empty, round(count(*) FILTER (WHERE p.n IS NULL) / count(*), 6) AS pos_empty_ratio,
    count(*) FILTER (WHERE q.n IS NULL) AS neg_empty, round(count(*) FILTER (WHERE q.n IS NULL) / count(*), 6) AS neg_empty_ratio
  FROM (SELECT *, {h('batch', 'drug', 'disease')} % 16 AS batch FROM sn) s LEFT JOIN qc p ON p.drug = s.drug AND p.disease = s.disease LEFT JOIN qc q ON q.drug = s.neg_drug AND q.disease = s.neg_disease GROUP BY batch""",
    ),
)
def empty_path_ratio(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    pairs = materialize(split_negatives(spark, sf_dir), "negatives").withColumn("batch", F.pmod(key_hash("batch", "drug", "disease"), F.lit(16)))
    # pairs of both signs are counted together, so the edges move once
    negative = F.struct(F.col("neg_drug").alias("drug"), F.col("neg_disease").alias("disease"))
    asked = pairs.select(F.inline(F.array(F.struct("drug", "disease"), negative)))
    counts = materialize(tp.pair_path_counts(asked, edges, links(spark, sf_dir)).select("drug", "disease", "n_quads"), "counts")
    for sign, drug, disease in (("pos", "drug", "disease"), ("neg", "neg_drug", "neg_disease")):
        named = counts.toDF(drug, disease, f"n_{sign}_paths")
        pairs = pairs.join(named, [drug, disease]).drop(drug, disease)
    return rounded(au.empty_path_ratio(pairs, ["batch"]), "pos_empty_ratio", "neg_empty_ratio")
