"""Identity, alias and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.graph import (
    classify_edge_type,
    edge_type_label,
    normalize_node_type,
    orient_pair,
    safe_type_name,
)
from ..functions.text import id_suffix, is_missing_text, numeric_suffix, safe_text
from ..operators import identity as ident
from ..operators import tables as tab
from ..operators.audits import relation_affix_report
from ..operators.graph import edge_counts_by_type, node_counts_by_type
from ..schema import DRUG, GENE
from .graph_store import build_nodes, graph, raw_edges, table
from .oracle import expect
from .registry import query

_ALIASES = """aliases AS (
  SELECT DISTINCT node_type, global_id, alias FROM (
    SELECT node_type, global_id, lower(trim(raw_id)) AS alias FROM nodes
    UNION ALL SELECT node_type, global_id, lower(trim(regexp_replace(raw_id, '^.*?::', ''))) FROM nodes
    UNION ALL SELECT node_type, global_id, lower(trim(name)) FROM nodes) WHERE alias <> ''),
counted AS (SELECT node_type, alias, count(*) AS n, min(global_id) AS first_id FROM aliases GROUP BY ALL)"""


def _with(names, ctes: str, body: str) -> str:
    return expect(names, "").rstrip() + ",\n" + ctes + "\n" + body


@query("nodes_with_ids", expect("nodes", "SELECT global_id, local_id, raw_id, node_type, name, source FROM nodes"))
def nodes_with_ids(spark, sf_dir):
    return build_nodes(spark, sf_dir)


@query("alias_unique", _with("nodes", _ALIASES, "SELECT node_type, alias, first_id AS global_id FROM counted WHERE n = 1"))
def alias_unique(spark, sf_dir):
    return ident.alias_index(graph(spark, sf_dir).nodes)[0]


@query(
    "alias_ambiguous",
    _with(
        "nodes", _ALIASES,
        "SELECT a.node_type, a.alias, a.global_id, n AS n_candidates FROM aliases a JOIN counted c USING (node_type, alias) WHERE n > 1",
    ),
)
def alias_ambiguous(spark, sf_dir):
    return ident.alias_index(graph(spark, sf_dir).nodes)[1]


_SOURCE_ALIASES = """forms AS (
  SELECT node_type, global_id, raw_id, lower(trim(raw_id)) AS alias FROM nodes WHERE node_type <> 'pathway'
  UNION ALL SELECT node_type, global_id, raw_id, regexp_replace(lower(raw_id), '^.*?::', '') FROM nodes WHERE node_type <> 'pathway'
  UNION ALL SELECT node_type, global_id, raw_id, lower(trim(name)) FROM nodes WHERE node_type <> 'pathway'
  UNION ALL SELECT node_type, global_id, raw_id, unnest(['entrez:' || sfx, 'ncbi:' || sfx]) FROM (SELECT *, regexp_replace(raw_id, '^.*?::', '') AS sfx FROM nodes) WHERE node_type = 'gene/protein'
  UNION ALL SELECT node_type, global_id, raw_id, unnest(['mondo:' || sfx, 'mondo:' || lpad(sfx, 7, '0'), 'mondo_' || lpad(sfx, 7, '0')]) FROM (SELECT *, regexp_replace(raw_id, '^.*?::', '') AS sfx FROM nodes) WHERE node_type = 'disease'),
first_wins AS (SELECT node_type, alias, arg_min(raw_id, global_id) AS raw_id, min(global_id) AS global_id FROM forms GROUP BY node_type, alias)"""


@query("alias_first_wins", _with("nodes", _SOURCE_ALIASES, "SELECT node_type, alias, raw_id, global_id FROM first_wins"))
def alias_first_wins(spark, sf_dir):
    return ident.alias_index_first_wins(graph(spark, sf_dir).nodes)


@query(
    "entity_lookup",
    _with(
        "nodes",
        _ALIASES
        + """, asked AS (
  SELECT DISTINCT 'gene/protein' AS node_type, '  ' || upper(p_name) AS value FROM part
  UNION ALL SELECT 'disease', upper(c_name) || ' ' FROM customer
  UNION ALL SELECT 'drug', CAST(s_suppkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'disease', n_name FROM nation)""",
        """SELECT q.node_type, value, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status,
  CASE WHEN n = 1 THEN first_id ELSE -1 END AS global_id, coalesce(n, 0) AS n_candidates
  FROM asked q LEFT JOIN counted c ON c.node_type = q.node_type AND c.alias = lower(trim(value))""",
    ),
)
def entity_lookup(spark, sf_dir):
    def values(name, node_type, expr):
        return table(spark, sf_dir, name).select(F.lit(node_type).alias("node_type"), F.expr(expr).alias("value"))

    asked = (
        values("part", GENE, "concat('  ', upper(p_name))").distinct()
        .unionByName(values("customer", "disease", "concat(upper(c_name), ' ')"))
        .unionByName(values("supplier", DRUG, "cast(s_suppkey as string)"))
        .unionByName(values("nation", "disease", "n_name"))
    )
    return ident.lookup_entity(asked, graph(spark, sf_dir).nodes).fillna(-1, ["global_id"])


def _named(spark, sf_dir):
    """Order lines as (drug, gene, disease) names: odd line numbers name the gene by id."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    keys = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
    joined = keys.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path_index"),
        F.col("l_suppkey").cast("string").alias("drug"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey").cast("string")).otherwise(F.col("p_name")).alias("gene"),
        F.concat(F.lit("disease::"), F.col("o_custkey").cast("string")).alias("disease"),
    )


_NAMED = _ALIASES + """, named AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS path_index, CAST(l_suppkey AS VARCHAR) AS drug,
    CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_partkey AS VARCHAR) ELSE p_name END AS gene, 'disease::' || o_custkey AS disease
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
looked AS (
  SELECT path_index, position, q.node_type, value, n, first_id FROM (
    SELECT path_index, 0 AS position, 'drug' AS node_type, drug AS value FROM named
    UNION ALL SELECT path_index, 1, 'gene/protein', gene FROM named
    UNION ALL SELECT path_index, 2, 'disease', disease FROM named) q
  LEFT JOIN counted c ON c.node_type = q.node_type AND c.alias = lower(trim(value)))"""


@query(
    "named_paths",
    _with(
        "nodes", _NAMED,
        """SELECT path_index, max(CASE WHEN position = 0 THEN first_id END) AS drug, max(CASE WHEN position = 1 THEN first_id END) AS gene,
  max(CASE WHEN position = 2 THEN first_id END) AS disease FROM looked GROUP BY path_index HAVING bool_and(coalesce(n = 1, false))""",
    ),
)
def named_paths(spark, sf_dir):
    return ident.paths_from_names(_named(spark, sf_dir), graph(spark, sf_dir).nodes, ("drug", "gene", "disease"))[0]


@query(
    "named_paths_rejected",
    _with(
        "nodes", _NAMED,
        """SELECT path_index, position, node_type AS expected_type, value, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS reason,
  coalesce(n, 0) AS n_candidates FROM looked WHERE coalesce(n, 0) <> 1""",
    ),
)
def named_paths_rejected(spark, sf_dir):
    return ident.paths_from_names(_named(spark, sf_dir), graph(spark, sf_dir).nodes, ("drug", "gene", "disease"))[1]


_LINE_ORDER = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount"


@query(
    "dedup_first",
    f"""SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM (SELECT *, row_number() OVER
  (PARTITION BY l_suppkey, l_partkey ORDER BY {_LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedup_first(spark, sf_dir):
    order = _LINE_ORDER.split(", ")
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", *order)
    return tab.dedup_keep_first(line, ["l_suppkey", "l_partkey"], order)


@query(
    "dedup_last",
    """SELECT user_id, event_id, event_type, value, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
  count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn = 1""",
)
def dedup_last(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return tab.dedup_keep_last(events, ["user_id"], ["ts", "event_id"], "n").drop("ts")


@query(
    "merge_records",
    """SELECT id, arg_min(name, rnk) FILTER (WHERE name IS NOT NULL) AS name, count(*) AS n_records FROM (
  SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, (0, c_custkey) AS rnk FROM customer
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'customer of ' || o_orderpriority, (1, o_orderkey) FROM orders) GROUP BY id""",
)
def merge_records(spark, sf_dir):
    first = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "case when c_acctbal < 0 then ' NaN ' else c_name end as name", "c_custkey as ord"
    )
    second = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as id", "concat('customer of ', o_orderpriority) as name", "o_orderkey as ord"
    )
    return tab.merge_records([first, second])


@query(
    "merge_stats",
    """SELECT count(*) + (SELECT count(*) FROM orders) AS total_records, (SELECT count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)) AS unique_ids,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 UNION SELECT o_custkey FROM orders)) AS valid_names,
  (SELECT count(*) FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)) AS invalid_names FROM customer""",
)
def merge_stats(spark, sf_dir):
    return tab.merge_stats(merge_records(spark, sf_dir))


@query(
    "merge_texts",
    """SELECT o_custkey, string_agg(piece, ', ' ORDER BY ord, pos) AS texts FROM (
  SELECT o_custkey, piece, min(ord) AS ord, arg_min(pos, (ord, pos)) AS pos FROM (
    SELECT o_custkey, o_orderkey AS ord, unnest([o_orderpriority, o_orderstatus]) AS piece, unnest([0, 1]) AS pos FROM orders)
  GROUP BY o_custkey, piece) GROUP BY o_custkey""",
)
def merge_texts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey", "concat(o_orderpriority, ' , ', o_orderstatus, ',') as cell"
    )
    return tab.merge_non_empty_texts(orders, "o_custkey", tab.comma_pieces("cell"), "o_orderkey", "texts")


@query(
    "merge_text_chunks",
    """SELECT o_custkey, chunk, string_agg(piece, ', ' ORDER BY ord, pos) AS text FROM (
  SELECT o_custkey, piece, ord, pos, floor((sum(strlen(piece) + 2) OVER (PARTITION BY o_custkey ORDER BY ord, pos) - strlen(piece) - 2) / 64)::BIGINT AS chunk FROM (
    SELECT o_custkey, piece, min(ord) AS ord, arg_min(pos, (ord, pos)) AS pos FROM (
      SELECT o_custkey, o_orderkey AS ord, unnest([o_orderpriority, 'order ' || o_orderkey]) AS piece, unnest([0, 1]) AS pos FROM orders)
    GROUP BY o_custkey, piece)) GROUP BY o_custkey, chunk""",
)
def merge_text_chunks(spark, sf_dir):
    """Priorities and orders of each customer in texts of about 64 bytes."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "concat(o_orderpriority, ' , order ', o_orderkey, ',') as cell")
    return tab.merge_non_empty_chunks(orders, "o_custkey", tab.comma_pieces("cell"), "o_orderkey", 64)


@query(
    "first_non_empty",
    """SELECT o_custkey, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), '') AS text FROM orders GROUP BY o_custkey""",
)
def first_non_empty(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderkey", "case when o_orderstatus = 'F' then ' none ' else o_orderpriority end as cell"
    )
    return orders.groupBy("o_custkey").agg(tab.first_non_empty("cell", "o_orderkey").alias("text"))


@query(
    "best_text",
    """SELECT p_partkey, arg_min(t, (position('::' IN t) > 0, regexp_matches(replace(t, '.', ''), '^[0-9]+$'), -length(t), t)) AS name FROM (
  SELECT p_partkey, unnest(['gene/protein::' || p_partkey, CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type]) AS t FROM part) GROUP BY p_partkey""",
)
def best_text(spark, sf_dir):
    candidates = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        "explode(array(concat('gene/protein::', p_partkey), cast(p_partkey as string), p_name, p_brand, p_type)) as text",
    )
    return tab.best_entity_text(candidates, ["p_partkey"])


_EDGE_COLUMNS = "src_id, src_type, rel, dst_type, dst_id"


@query(
    "edge_table",
    expect("edges", f"""SELECT {_EDGE_COLUMNS} FROM edges
  UNION ALL SELECT dst_id, dst_type, rel || '__reverse__', src_type, src_id FROM edges"""),
)
def edge_table(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes
    return ident.build_edge_table(nodes, raw_edges(spark, sf_dir), add_inverse=True, on_missing="error")


@query(
    "id_layout",
    expect(
        "nodes",
        """SELECT 'global' AS scope, count(*) AS n, min(global_id) AS min_id, max(global_id) AS max_id, true AS contiguous FROM nodes
  UNION ALL SELECT node_type, count(*), min(local_id), max(local_id), max(local_id) - min(local_id) + 1 = count(*) FROM nodes GROUP BY node_type""",
    ),
)
def id_layout(spark, sf_dir):
    return ident.id_layout(graph(spark, sf_dir).nodes)


@query(
    "path_violations",
    expect(
        "nodes",
        """SELECT drug, gene, disease, position, node_id FROM (
  SELECT drug, gene, disease, unnest(['drug', 'gene', 'disease']) AS position, unnest(['drug', 'gene/protein', 'disease']) AS t, unnest([drug, gene, disease]) AS node_id
  FROM (SELECT DISTINCT l_suppkey AS drug, l_partkey AS gene, l_orderkey AS disease FROM lineitem)) p
  WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_type = t AND n.global_id = node_id)""",
    ),
)
def path_violations(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as drug", "l_partkey as gene", "l_orderkey as disease")
    return ident.path_violations(paths.distinct(), graph(spark, sf_dir).nodes)


@query(
    "named_edges",
    expect(
        "edges",
        """SELECT src_id, rel, dst_id, a.name AS src_name, coalesce(b.name, 'Unknown') AS dst_name FROM edges
  JOIN nodes a ON a.global_id = src_id LEFT JOIN nodes b ON b.global_id = dst_id AND b.node_type <> 'pathway'""",
    ),
)
def named_edges(spark, sf_dir):
    g = graph(spark, sf_dir)
    named = ident.attach_names(g.edges, g.nodes, "src_id", "src_name")
    known = g.nodes.filter("node_type <> 'pathway'")
    return ident.attach_names(named, known, "dst_id", "dst_name").select("src_id", "rel", "dst_id", "src_name", "dst_name")


@query(
    "node_types",
    expect(
        "nodes",
        """SELECT raw_id, written, CASE replace(lower(trim(written)), '_', '/') WHEN 'drug' THEN 'drug' WHEN 'compound' THEN 'drug' WHEN 'gene' THEN 'gene/protein'
  WHEN 'protein' THEN 'gene/protein' WHEN 'gene/protein' THEN 'gene/protein' WHEN 'disease' THEN 'disease' WHEN 'phenotype' THEN 'disease'
  WHEN 'pathway' THEN 'pathway' ELSE trim(written) END AS node_type FROM (
  SELECT raw_id, CASE local_id % 5 WHEN 0 THEN ' ' || upper(node_type) WHEN 1 THEN replace(node_type, '/', '_') WHEN 2 THEN 'Compound '
    WHEN 3 THEN ' molecular_function' ELSE split_part(node_type, '/', 1) END AS written FROM nodes)""",
    ),
)
def node_types(spark, sf_dir):
    written = graph(spark, sf_dir).nodes.selectExpr(
        "raw_id",
        """case local_id % 5 when 0 then concat(' ', upper(node_type)) when 1 then replace(node_type, '/', '_')
        when 2 then 'Compound ' when 3 then ' molecular_function' else split_part(node_type, '/', 1) end as written""",
    )
    return written.withColumn("node_type", normalize_node_type("written"))


@query(
    "relations",
    expect(
        "edges",
        """SELECT form AS rel, n AS n_edges, CASE k WHEN 4 THEN form ELSE base END AS plain_rel, base AS batch_rel,
  CASE k WHEN 3 THEN form WHEN 5 THEN ' ' || base ELSE base END AS sampler_rel FROM (
  SELECT rel AS base, count(*) AS n, unnest([0, 1, 2, 3, 4, 5]) AS k,
    unnest([rel, 'rev_' || rel, rel || '__reverse__', 'reverse_' || rel, rel || '_reverse', ' ' || rel]) AS form FROM edges GROUP BY rel)""",
    ),
)
def relations(spark, sf_dir):
    forms = "array(rel, concat('rev_', rel), concat(rel, '__reverse__'), concat('reverse_', rel), concat(rel, '_reverse'), concat(' ', rel))"
    written = graph(spark, sf_dir).edges.selectExpr(f"explode({forms}) as rel")
    return relation_affix_report(written)


@query(
    "oriented_pairs",
    expect(
        "edges",
        """SELECT src_id AS drug, dst_id AS gene, rel FROM edges WHERE rel = 'targets'
  UNION ALL SELECT src_id, dst_id, rel || '__reverse__' FROM edges WHERE rel = 'targets'""",
    ),
)
def oriented_pairs(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    both = edges.unionByName(ident.reverse_edges(edges))
    return orient_pair(both, DRUG, GENE, ("drug", "gene"))


@query(
    "missing_text",
    """SELECT c_custkey, cell IS NULL OR lower(trim(cell)) IN ('', 'nan', 'none', 'null') AS is_missing,
  CASE WHEN cell IS NULL OR lower(trim(cell)) IN ('', 'nan', 'none', 'null') THEN 'Unknown' ELSE trim(cell) END AS text FROM (
  SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN NULL WHEN c_acctbal < 0 THEN ' NaN ' WHEN c_acctbal < 500 THEN '  ' WHEN c_acctbal < 1000 THEN 'None'
    ELSE ' ' || c_mktsegment || ' ' END AS cell FROM customer)""",
)
def missing_text(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        """case when c_acctbal < -500 then null when c_acctbal < 0 then ' NaN ' when c_acctbal < 500 then '  '
        when c_acctbal < 1000 then 'None' else concat(' ', c_mktsegment, ' ') end as cell""",
    )
    return cells.select(
        "c_custkey", is_missing_text("cell").alias("is_missing"), safe_text("cell", "Unknown").alias("text")
    )


@query(
    "edge_categories",
    expect(
        "edges",
        """SELECT src_type || '|' || rel || '|' || dst_type AS edge_type, CASE WHEN src_type = 'drug' AND dst_type = 'disease' THEN 'direct_leakage' ELSE 'mechanistic' END AS category,
  count(*) AS n_edges FROM edges GROUP BY ALL""",
    ),
)
def edge_categories(spark, sf_dir):
    edges = graph(spark, sf_dir).edges
    return edges.groupBy(edge_type_label().alias("edge_type"), classify_edge_type().alias("category")).agg(
        F.count("*").alias("n_edges")
    )


@query(
    "entrez_ids",
    expect(
        "nodes",
        """SELECT raw_id, regexp_replace(raw_id, '^.*?::', '') AS suffix, nullif(regexp_extract(raw_id, '([0-9]+)$', 1), '') AS number,
  replace(replace(replace(node_type, '/', '_'), ' ', '_'), '-', '_') AS type_name FROM nodes""",
    ),
)
def entrez_ids(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select(
        "raw_id",
        id_suffix("raw_id").alias("suffix"),
        numeric_suffix("raw_id").alias("number"),
        safe_type_name("node_type").alias("type_name"),
    )


@query(
    "missingness",
    expect(
        (),
        """SELECT 'c_name' AS "column", count(*) AS n_rows, 0 AS nulls, 0 AS empties FROM customer
  UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (WHERE c_acctbal < 0), count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 1000) FROM customer""",
    ),
)
def missingness(spark, sf_dir):
    cells = table(spark, sf_dir, "customer").selectExpr(
        "c_name", "case when c_acctbal < 0 then null when c_acctbal < 1000 then ' ' else c_mktsegment end as c_mktsegment"
    )
    return tab.missingness_profile(cells)


@query(
    "id_patterns",
    expect(
        "nodes",
        """SELECT node_type, round(num, 9) AS numeric_ratio, round(aln, 9) AS alnum_ratio, CASE WHEN num > 0.95 THEN 'numeric' WHEN aln > 0.95 THEN 'alphanumeric' ELSE 'mixed' END AS pattern
  FROM (SELECT node_type, avg(CASE WHEN regexp_full_match(s, '[0-9]+') THEN 1.0::DOUBLE ELSE 0.0 END) AS num,
    avg(CASE WHEN regexp_full_match(s, '[A-Za-z0-9._-]+') THEN 1.0::DOUBLE ELSE 0.0 END) AS aln
  FROM (SELECT node_type, regexp_replace(raw_id, '^.*::', '') AS s FROM nodes) GROUP BY node_type)""",
    ),
)
def id_patterns(spark, sf_dir):
    return tab.id_pattern(graph(spark, sf_dir).nodes, ["node_type"], "raw_id").withColumns(
        {c: F.round(c, 9) for c in ("numeric_ratio", "alnum_ratio")}
    )


@query(
    "edge_counts",
    expect("edges", "SELECT src_type, rel, dst_type, count(*) AS n_edges FROM edges GROUP BY ALL"),
)
def edge_counts(spark, sf_dir):
    return edge_counts_by_type(graph(spark, sf_dir).edges)


@query(
    "node_counts",
    expect(
        "nodes",
        "SELECT node_type, count(*) AS n_nodes, max(global_id) AS max_global_id, max(local_id) AS max_local_id FROM nodes GROUP BY node_type",
    ),
)
def node_counts(spark, sf_dir):
    return node_counts_by_type(graph(spark, sf_dir).nodes)


@query("unique_names", "SELECT DISTINCT regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS name FROM part")
def unique_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("concat(' ', replace(p_name, ' ', '   ')) as name")
    return tab.unique_names(parts, "name", None)
