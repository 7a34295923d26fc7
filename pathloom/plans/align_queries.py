"""Queries that align association tables with the graph.

The associations are the order lines themselves: those of little discount link customers to the parts
they ordered, and by all others suppliers target parts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import list_literal
from ..lineage import materialize
from ..operators import align as al
from ..operators import tables as tab
from .audit_queries import rounded
from .derived import splits
from .graph_store import graph, table
from .oracle import expect
from .registry import query

_DT = """dt AS (SELECT drug_id, target_id, arg_min(drug_name, k) AS drug_name, arg_min(target_name, k) AS target_name FROM (
    SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'ext' ELSE '' END || l_suppkey AS drug_id, CAST(l_partkey AS VARCHAR) AS target_id, s_name AS drug_name, p_name AS target_name,
      (l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_discount > 0.01::DOUBLE) GROUP BY drug_id, target_id),
  td AS (SELECT target_id, disease_id, arg_min(disease_name, k) AS disease_name FROM (
    SELECT CAST(l_partkey AS VARCHAR) AS target_id, CASE WHEN l_returnflag = 'A' THEN 'MONDO:' || o_custkey WHEN l_returnflag = 'R' THEN 'X' || o_custkey ELSE 'mondo_' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS disease_id,
      CASE WHEN l_linenumber = 1 THEN 'unheard of' ELSE c_name END AS disease_name, (l_orderkey, l_linenumber, l_extendedprice) AS k
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_discount <= 0.01::DOUBLE) GROUP BY target_id, disease_id),
  cand AS (SELECT drug_id, target_id, disease_id, drug_name, disease_name, target_name FROM dt JOIN td USING (target_id))"""

# drugs resolve by id or name, targets by id, diseases by one of two id forms or
# by name; a shared alias would go to the first node, but these are unique
_ALIGNED = _DT + """, aligned AS (
  SELECT cand.*, 'drug::' || CASE WHEN drug_id LIKE 'ext%' THEN CAST(s.s_suppkey AS VARCHAR) ELSE drug_id END AS kg_drug, 'gene/protein::' || target_id AS kg_target,
    'disease::' || CASE WHEN disease_id LIKE 'MONDO:%' THEN substr(disease_id, 7) WHEN disease_id LIKE 'mondo_%' THEN CAST(CAST(substr(disease_id, 7) AS BIGINT) AS VARCHAR) ELSE CAST(c.c_custkey AS VARCHAR) END AS kg_disease
  FROM cand LEFT JOIN supplier s ON s.s_name = drug_name LEFT JOIN customer c ON c.c_name = disease_name),
  full_triples AS (SELECT DISTINCT kg_drug, kg_target, kg_disease FROM aligned WHERE kg_drug IS NOT NULL AND kg_target IS NOT NULL AND kg_disease IS NOT NULL),
  train AS (SELECT DISTINCT 'drug::' || a.s AS kg_drug, 'disease::' || a.c AS kg_disease FROM (
    SELECT regexp_replace(n.raw_id, '^.*::', '') AS s, regexp_replace(m.raw_id, '^.*::', '') AS c FROM split_random JOIN nodes n ON n.global_id = drug JOIN nodes m ON m.global_id = disease WHERE split = 'train') a),
  marked AS (SELECT f.*, t.kg_drug IS NOT NULL AS hit FROM full_triples f LEFT JOIN train t USING (kg_drug, kg_disease))"""


def _sql(base: str, body: str) -> str:
    if base is _DT:
        return "WITH " + base + "\n" + body
    return expect(("split_random", "nodes"), ", " + base + "\n" + body)


def drug_target(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter("l_discount > 0.01")
    joined = line.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(
        table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")
    )
    rows = joined.selectExpr(
        "concat(case when l_linenumber % 2 = 0 then 'ext' else '' end, l_suppkey) as drug_id",
        "cast(l_partkey as string) as target_id",
        "s_name as drug_name",
        "p_name as target_name",
        "struct(l_orderkey, l_linenumber, l_extendedprice) as ord",
    )
    return al.clean_associations(rows, ("drug_id", "target_id"))


def target_disease(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter("l_discount <= 0.01")
    joined = line.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")
    )
    rows = joined.selectExpr(
        "cast(l_partkey as string) as target_id",
        """case when l_returnflag = 'A' then concat('MONDO:', o_custkey) when l_returnflag = 'R' then concat('X', o_custkey)
        else concat('mondo_', lpad(cast(o_custkey as string), 7, '0')) end as disease_id""",
        "case when l_linenumber = 1 then 'unheard of' else c_name end as disease_name",
        "struct(l_orderkey, l_linenumber, l_extendedprice) as ord",
    )
    return al.clean_associations(rows, ("target_id", "disease_id"))


def candidates(spark, sf_dir):
    return al.bridge_join(drug_target(spark, sf_dir), target_disease(spark, sf_dir))


def aligned(spark, sf_dir):
    return al.align_associations(drug_target(spark, sf_dir), target_disease(spark, sf_dir), graph(spark, sf_dir).nodes)


def resolved(spark, sf_dir):
    return al.resolve_associations(drug_target(spark, sf_dir), target_disease(spark, sf_dir), graph(spark, sf_dir).nodes)


def marked(spark, sf_dir):
    """Distinct resolved triples, flagged where their pair is a training pair."""
    return al.mapped_triples(*resolved(spark, sf_dir), train_pairs(spark, sf_dir))


def train_pairs(spark, sf_dir):
    train = splits(spark, sf_dir, "random").filter("split = 'train'")
    return al.training_pairs_from(train, graph(spark, sf_dir).nodes)


@query("bridge_join", _sql(_DT, "SELECT * FROM cand"))
def bridge_join(spark, sf_dir):
    return candidates(spark, sf_dir)


@query("resolve_entities", _sql(_ALIGNED, "SELECT drug_id, target_id, disease_id, drug_name, disease_name, target_name, kg_drug, kg_target, kg_disease FROM aligned"))
def resolve_entities(spark, sf_dir):
    return aligned(spark, sf_dir)


@query(
    "resolve_mapped",
    _sql(
        _ALIGNED,
        """SELECT DISTINCT target_id, 'gene/protein::' || coalesce(m.p, CAST(target_id AS BIGINT)) AS kg_target FROM cand
  LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS p FROM part) m ON m.p_partkey = CAST(target_id AS BIGINT)""",
    ),
)
def resolve_mapped(spark, sf_dir):
    """Targets under an external mapping that folds parts onto one per brand and size."""
    part = table(spark, sf_dir, "part")
    heads = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("head"))
    mapping = part.join(heads, ["p_brand", "p_size"]).selectExpr("cast(p_partkey as string) as source", "concat('gene/protein::', head) as target")
    sides = [df.drop("target_name") for df in (drug_target(spark, sf_dir), target_disease(spark, sf_dir))]
    out = al.align_associations(*sides, graph(spark, sf_dir).nodes, {"target": mapping})
    return out.select("target_id", "kg_target").distinct()


@query("full_triples", _sql(_ALIGNED, "SELECT * FROM full_triples"))
def full_triples(spark, sf_dir):
    return al.mapped_triples(*resolved(spark, sf_dir))


@query("overlap", _sql(_ALIGNED, "SELECT kg_drug, kg_target, kg_disease FROM marked WHERE hit"))
def overlap(spark, sf_dir):
    return al.split_overlap_novel(marked(spark, sf_dir))[0]


@query("novel", _sql(_ALIGNED, "SELECT kg_drug, kg_target, kg_disease FROM marked WHERE NOT hit"))
def novel(spark, sf_dir):
    return al.split_overlap_novel(marked(spark, sf_dir))[1]


_NOVELTY = """SELECT count(*) AS n_aligned, count(*) FILTER (WHERE hit) AS n_overlap, count(*) FILTER (WHERE NOT hit) AS n_novel,
  round(count(*) FILTER (WHERE hit) / count(*), 6) AS overlap_ratio, round(count(*) FILTER (WHERE NOT hit) / count(*), 6) AS novel_ratio,
  count(DISTINCT (kg_drug, kg_disease)) FILTER (WHERE hit) AS overlap_pairs, count(DISTINCT (kg_drug, kg_disease)) FILTER (WHERE NOT hit) AS novel_pairs FROM marked"""


@query("novelty_report", _sql(_ALIGNED, _NOVELTY))
def novelty_report(spark, sf_dir):
    return rounded(al.novelty_report(marked(spark, sf_dir)), "overlap_ratio", "novel_ratio")


def _side(side: str) -> str:
    return f"""SELECT '{side}' AS scope, count(*) AS n_triples, count(kg_{side}) AS n_mapped, round(count(kg_{side}) / count(*), 6) AS triple_rate, count(DISTINCT {side}_id) AS n_entities,
  count(DISTINCT {side}_id) FILTER (WHERE kg_{side} IS NOT NULL) AS n_mapped_entities, round(count(DISTINCT {side}_id) FILTER (WHERE kg_{side} IS NOT NULL) / count(DISTINCT {side}_id), 6) AS entity_rate FROM aligned"""


_WHOLE = "kg_drug IS NOT NULL AND kg_target IS NOT NULL AND kg_disease IS NOT NULL"


@query(
    "mapping_report",
    _sql(
        _ALIGNED,
        " UNION ALL ".join(_side(s) for s in ("drug", "target", "disease"))
        + f""" UNION ALL SELECT 'triple', count(*), count(*) FILTER (WHERE {_WHOLE}), round(count(*) FILTER (WHERE {_WHOLE}) / count(*), 6), count(DISTINCT (drug_id, target_id, disease_id)),
  count(DISTINCT (kg_drug, kg_target, kg_disease)) FILTER (WHERE {_WHOLE}), round(count(DISTINCT (drug_id, target_id, disease_id)) FILTER (WHERE {_WHOLE}) / count(DISTINCT (drug_id, target_id, disease_id)), 6) FROM aligned""",
    ),
)
def mapping_report(spark, sf_dir):
    sides = resolved(spark, sf_dir)
    return rounded(al.mapping_report(al.join_resolved(*sides), al.mapped_triples(*sides), sides), "triple_rate", "entity_rate")


@query(
    "alignment_report",
    _sql(
        _ALIGNED,
        f"""SELECT 'input' AS section, 'drug_target' AS key, count(*)::DOUBLE AS value FROM dt UNION ALL SELECT 'input', 'target_disease', count(*) FROM td
  UNION ALL SELECT 'construction', 'candidates', count(*) FROM cand
  UNION ALL SELECT 'novelty', unnest(['n_aligned', 'n_overlap', 'n_novel', 'overlap_ratio', 'novel_ratio', 'overlap_pairs', 'novel_pairs']),
    unnest([n_aligned::DOUBLE, n_overlap, n_novel, overlap_ratio, novel_ratio, overlap_pairs, novel_pairs]) FROM ({_NOVELTY})
  UNION ALL SELECT 'novel_entities', unnest(['drugs', 'targets', 'diseases', 'pairs']), unnest([count(DISTINCT kg_drug)::DOUBLE, count(DISTINCT kg_target), count(DISTINCT kg_disease), count(DISTINCT (kg_drug, kg_disease))]) FROM marked WHERE NOT hit""",
    ),
)
def alignment_report(spark, sf_dir):
    dt, td = materialize(drug_target(spark, sf_dir), "drug_target"), materialize(target_disease(spark, sf_dir), "target_disease")
    sides = al.resolve_associations(dt, td, graph(spark, sf_dir).nodes)
    triples = al.mapped_triples(*sides, train_pairs(spark, sf_dir))
    return rounded(al.alignment_report(dt, td, al.bridge_join(dt, td), triples), "value")


# --- static tables, patches and resumed runs ---


@query(
    "attach_static",
    """SELECT 'drug::' || s_suppkey AS node_id, s_name AS name, coalesce(p_type, 'NOT_FOUND') AS smiles FROM supplier
  LEFT JOIN (SELECT l_suppkey, arg_min(CASE WHEN p_size > 30 THEN p_type ELSE 'NOT_FOUND' END, (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS p_type FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey) ON l_suppkey = s_suppkey""",
)
def attach_static(spark, sf_dir):
    drugs = table(spark, sf_dir, "supplier").selectExpr("concat('drug::', s_suppkey) as node_id", "s_name as name")
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    static = line.join(part, F.col("p_partkey") == F.col("l_partkey")).selectExpr(
        "cast(l_suppkey as string) as static_id", "case when p_size > 30 then p_type end as smiles", "struct(l_orderkey, l_linenumber, l_partkey, l_extendedprice) as ord"
    )
    return tab.attach_static(drugs, static)


_PATCHED = """SELECT c_custkey, c_name AS name, coalesce(p.st, CASE WHEN c_acctbal < 0 THEN 'NOT_FOUND' WHEN c_acctbal < 2000 THEN NULL ELSE c_mktsegment END) AS smiles FROM customer
  LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS st FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) p ON o_custkey = c_custkey"""


@query("patch_missing", _PATCHED)
def patch_missing(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    base = customers.selectExpr(
        "c_custkey", "c_name as name", "case when c_acctbal < 0 then 'NOT_FOUND' when c_acctbal < 2000 then null else c_mktsegment end as smiles"
    )
    found = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "concat(' ', c_name, ' ') as name", "case o_orderstatus when 'P' then o_orderpriority when 'F' then 'ERROR' else 'NOT_FOUND' end as smiles", "o_orderkey as ord"
    )
    return tab.patch_missing(base, found)


@query(
    "match_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE smiles IS NOT NULL AND smiles NOT IN ('NOT_FOUND', 'ERROR')) AS matched,
  count(*) FILTER (WHERE smiles IS NULL OR smiles IN ('NOT_FOUND', 'ERROR')) AS missing FROM ({_PATCHED})""",
)
def match_counts(spark, sf_dir):
    return tab.match_counts(patch_missing(spark, sf_dir))


@query(
    "resume_pending",
    """SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (
  SELECT o_custkey FROM (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st FROM orders GROUP BY o_custkey) WHERE st IN ('P', 'F'))""",
)
def resume_pending(spark, sf_dir):
    names = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name as name")
    results = table(spark, sf_dir, "orders").join(names, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "name", "o_orderkey as ord", "case o_orderstatus when 'P' then ' found' when 'F' then 'Not_Found ' else 'ERROR' end as status"
    )
    return tab.resume_pending(names.select("name"), results)


@query(
    "thick_table",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal < 0 THEN coalesce(label, '') ELSE c_name END AS name, coalesce(ancestors, '') AS ancestors, coalesce(definition, '') AS definition FROM customer
  LEFT JOIN (SELECT o_custkey, arg_min('order ' || o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS label FROM orders GROUP BY o_custkey) l ON l.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, string_agg(piece, ', ' ORDER BY ord, pos) AS ancestors FROM (SELECT o_custkey, piece, min(ord) AS ord, arg_min(pos, (ord, pos)) AS pos FROM (
    SELECT o_custkey, o_orderkey AS ord, unnest([o_orderpriority, o_orderstatus]) AS piece, unnest([0, 1]) AS pos FROM orders) GROUP BY o_custkey, piece) GROUP BY o_custkey) a ON a.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, arg_min(CAST(o_totalprice AS VARCHAR), o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS definition FROM orders GROUP BY o_custkey) d ON d.o_custkey = c_custkey""",
)
def thick_table(spark, sf_dir):
    base = table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as id", "case when c_acctbal < 0 then 'null' else c_name end as name"
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey as string) as id", "o_orderkey as ord",
        "case when o_orderstatus = 'F' then 'nan' else concat('order ', o_orderkey) end as label",
        "concat(\"['\", o_orderpriority, \"', '\", o_orderstatus, \"', '\", o_orderpriority, \"']\") as ancestors",
        "case when o_orderstatus = 'P' then cast(o_totalprice as string) end as definition",
    )
    labels = orders.groupBy("id").agg(tab.first_non_empty("label", "ord").alias("label"))
    ancestors = tab.merge_non_empty_texts(orders, "id", list_literal("ancestors"), "ord", "ancestors")
    definitions = orders.groupBy("id").agg(tab.first_non_empty("definition", "ord").alias("definition"))
    return tab.thick_entity_table(base, labels.join(ancestors, "id", "left"), definitions)
