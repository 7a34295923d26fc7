"""Reader and writer queries: round trips through the shared folder and row-level parsing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions.graph import path_to_pair
from ..functions.text import is_missing_smiles
from ..lineage import shared_folder
from ..operators import identity as ident
from ..operators import tables as tab
from ..operators import vectors as ve
from ..operators.checks import preview, require_columns
from ..sources import readers, writers
from .derived import splits, triplets
from .graph_store import graph, table
from .oracle import expect
from .registry import query
from .vector_queries import entity_vectors


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "split_asset",
    expect(
        ("split_random", "split_cross_drug"),
        "SELECT 'random' AS mode, split, drug, disease FROM split_random UNION ALL SELECT 'cross_drug', split, drug, disease FROM split_cross_drug",
    ),
)
def split_asset(spark, sf_dir):
    """Two split modes written to one asset and read back."""
    path = _path(spark, "asset")
    modes = ("random", "cross_drug")
    for n, mode in enumerate(modes):
        writers.write_pair_splits(splits(spark, sf_dir, mode), path, mode, overwrite=n > 0)
    parts = [readers.read_pair_splits(spark, path, m).select(F.lit(m).alias("mode"), "*") for m in modes]
    return parts[0].unionByName(parts[1])


_FEATURES = """, f AS (SELECT node_type, global_id, len(embedding) AS d FROM nodes JOIN embeddings ON vec_id + 1 = global_id)"""


@query(
    "features_report",
    expect(
        "nodes",
        _FEATURES
        + """ SELECT n.node_type, n.c AS n_nodes, coalesce(f.c, 0) AS n_rows, coalesce(f.d, 0) AS min_dim, coalesce(f.d, 0) AS max_dim, CASE WHEN f.c IS NULL THEN 'missing' WHEN f.c <> n.c THEN 'mismatch' ELSE 'ok' END AS status
  FROM (SELECT node_type, count(*) AS c FROM nodes GROUP BY node_type) n LEFT JOIN (SELECT node_type, count(*) AS c, max(d) AS d FROM f GROUP BY node_type) f USING (node_type)""",
    ),
)
def features_report(spark, sf_dir):
    """Vectors written by node type, then checked against the node table."""
    nodes = graph(spark, sf_dir).nodes
    owned = entity_vectors(spark, sf_dir).withColumnRenamed("key", "global_id").join(
        nodes.select("node_type", "global_id"), "global_id"
    )
    path = _path(spark, "features")
    writers.write_features_by_type(owned.select("node_type", "global_id", "vec"), path)
    return readers.read_features_by_type(spark, path, nodes)[1].fillna(0, ["n_rows", "min_dim", "max_dim"])


@query(
    "feature_metadata",
    expect(
        "nodes",
        _FEATURES + " SELECT node_type, count(*) AS n_rows, max(global_id) AS max_id, max(d) AS dim FROM f GROUP BY node_type",
    ),
)
def feature_metadata(spark, sf_dir):
    nodes = graph(spark, sf_dir).nodes.select("node_type", "global_id")
    return writers.feature_metadata(entity_vectors(spark, sf_dir).withColumnRenamed("key", "global_id").join(nodes, "global_id"))


@query(
    "csv_graph",
    expect("edges", "SELECT src_id, src_type, rel, dst_type, dst_id FROM edges"),
)
def csv_graph(spark, sf_dir):
    """Nodes and edges exported as CSV and read back into an edge table."""
    g = graph(spark, sf_dir)
    raw = g.nodes.selectExpr("raw_id as id", "node_type as type", "name", "source")
    names = g.nodes.select("global_id", "raw_id")
    edges = (
        g.edges.join(names.withColumnsRenamed({"global_id": "src_id", "raw_id": "_s"}), "src_id")
        .join(names.withColumnsRenamed({"global_id": "dst_id", "raw_id": "_d"}), "dst_id")
        .selectExpr("_s as src_id", "src_type", "rel", "_d as dst_id", "dst_type")
    )
    folder = _path(spark, "csv")
    writers.write_table(raw, f"{folder}/nodes", "csv")
    writers.write_table(edges, f"{folder}/edges", "csv")
    read = readers.read_nodes(spark, f"{folder}/nodes").join(names, "raw_id")
    return ident.build_edge_table(read, readers.read_edges(spark, f"{folder}/edges"), on_missing="error")


@query(
    "csv_names",
    expect("nodes", """SELECT raw_id, CASE WHEN global_id % 3 = 0 THEN 'a "' || name || '", b,' || chr(10) || ' c' ELSE name END AS name FROM nodes"""),
)
def csv_names(spark, sf_dir):
    """Node names with quotes, commas and line breaks, written as CSV and read back."""
    odd = "case when global_id % 3 = 0 then concat('a \"', name, '\", b,\\n c') else name end as name"
    folder = _path(spark, "names")
    raw = graph(spark, sf_dir).nodes.selectExpr("raw_id as id", "node_type as type", odd, "source")
    raw.write.option("header", True).option("escape", '"').csv(folder)
    return readers.read_nodes(spark, folder, with_position=False).select("raw_id", "name")


@query(
    "table_formats",
    " UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS n_rows, max(s_name) AS last FROM supplier" for f in ("csv", "tsv", "parquet", "jsonl")),
)
def table_formats(spark, sf_dir):
    """One table in four formats, told apart by the folder's suffix, its columns standardised and resolved."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias(" Supplier-Name "), F.col("s_suppkey").cast("string").alias("ID"))
    parts = []
    for suffix in ("csv", "tsv", "parquet", "jsonl"):
        path = f"{_path(spark, 'table')}.{suffix}"
        if suffix in ("csv", "tsv"):
            rows.write.option("header", True).option("sep", "," if suffix == "csv" else "\t").csv(path)
        elif suffix == "jsonl":
            rows.write.json(path)
        else:
            rows.write.parquet(path)
        read = readers.standardize_columns(readers.read_table(spark, path))
        name = readers.resolve_column(require_columns(read, ["id"], path), ["label", "supplier_name"])
        parts.append(read.agg(F.lit(suffix).alias("format"), F.count("*").alias("n_rows"), F.max(name).alias("last")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "path_file",
    expect("pt_random", "SELECT drug, gene, disease FROM pt_random"),
)
def path_file(spark, sf_dir):
    """Mechanism paths written as CSV under their long column names and read back."""
    path = f"{_path(spark, 'paths')}.csv"
    rows = triplets(spark, sf_dir, "random").selectExpr("disease as disease_id", "gene as gene_id", "drug as drug_id", "split")
    writers.write_table(rows, path, "csv")
    return readers.read_paths(spark, path)


@query(
    "mapping_file",
    "SELECT 'cust ' || c_custkey AS source, lower(c_mktsegment) AS target FROM customer",
)
def mapping_file(spark, sf_dir):
    path = f"{_path(spark, 'mapping')}.csv"
    rows = table(spark, sf_dir, "customer").selectExpr("concat(' Cust  ', c_custkey) as From_ID", "c_mktsegment as `Mapped ID`", "c_name as other")
    writers.write_table(rows, path, "csv")
    return readers.read_mapping(spark, path)


@query(
    "path_json",
    expect("pt_random", "SELECT drug, gene, disease FROM pt_random"),
)
def path_json(spark, sf_dir):
    """Mechanism paths written as JSON lists of rows and read back in parts."""
    path = f"{_path(spark, 'paths')}.json"
    rows = triplets(spark, sf_dir, "random").select(F.to_json(F.array("drug", "gene", "disease")).alias("row"))
    writers.write_json_rows(rows, "row", path)
    return readers.read_paths(spark, path)


@query(
    "mapping_json",
    "SELECT 'cust ' || c_custkey AS source, lower(c_mktsegment) || ' {\"x\", [1]}' AS target FROM customer",
)
def mapping_json(spark, sf_dir):
    """A mapping as JSON objects whose texts hold quotes, commas and brackets."""
    path = f"{_path(spark, 'mapping')}.json"
    value = F.to_json(F.struct(F.concat("c_mktsegment", F.lit(' {"x", [1]}')).alias("v")))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" Cust  "), "c_custkey").alias("key"), F.regexp_extract(value, r'(?s)^\{"v":(.*)\}$', 1).alias("value"))
    writers.write_json_object(rows, path)
    return readers.read_mapping(spark, path)


@query("entity_map", expect("nodes", "SELECT node_type, global_id, name FROM nodes"))
def entity_map(spark, sf_dir):
    """Names and raw ids of all nodes as JSON objects by type; the name is the better text of an id."""
    path = f"{_path(spark, 'entity_map')}.json"
    nodes = graph(spark, sf_dir).nodes
    rows = nodes.select(
        F.col("node_type").alias("outer"), F.explode(F.array(F.col("raw_id"), F.concat("name", F.lit(" #"), "global_id"))).alias("key"),
        F.col("global_id").cast("string").alias("value"))
    writers.write_json_object(rows, path)
    found = readers.read_entity_map(spark, path)
    return found.withColumn("name", F.regexp_replace("name", " #[0-9]+$", ""))


@query("entity_records", expect("nodes", "SELECT node_type, global_id, CASE WHEN global_id % 3 = 0 THEN raw_id ELSE name END AS name FROM nodes"))
def entity_records(spark, sf_dir):
    """The same as JSON lists of records; where a name is blank the text stands for it."""
    path = f"{_path(spark, 'entity_records')}.json"
    name = F.when(F.col("global_id") % 3 == 0, F.lit(" ")).otherwise(F.col("name"))
    writers.write_json_list(graph(spark, sf_dir).nodes.select("global_id", "node_type", name.alias("name"), F.col("raw_id").alias("text")), path)
    return readers.read_entity_map(spark, path)


@query(
    "id_texts",
    "SELECT 'c' || c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment || ', \"quoted\" }' END AS mechanism_text FROM customer",
)
def id_texts(spark, sf_dir):
    """Customers as JSON objects by id; a spelling of nothing reads as empty."""
    path = f"{_path(spark, 'id_texts')}.json"
    text = F.when(F.col("c_acctbal") < 0, F.lit("NaN")).otherwise(F.concat("c_mktsegment", F.lit(', "quoted" }')))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("key"), F.to_json(F.struct(F.col("c_name").alias("name"), text.alias("mechanism_text"))).alias("value"))
    writers.write_json_object(rows, path)
    return readers.read_id_text(spark, path)


@query(
    "appended_results",
    "SELECT c_custkey AS key, c_mktsegment AS status FROM customer UNION ALL SELECT c_custkey, 'again' FROM customer WHERE c_acctbal < 0",
)
def appended_results(spark, sf_dir):
    path = _path(spark, "results")
    rows = table(spark, sf_dir, "customer")
    writers.append_results(rows.selectExpr("c_custkey as key", "c_mktsegment as status"), path)
    writers.append_results(rows.filter("c_acctbal < 0").selectExpr("c_custkey as key", "'again' as status"), path)
    return spark.read.parquet(path)


@query(
    "entity_text_file",
    expect("nodes", "SELECT global_id, coalesce(name, '') AS name, CASE WHEN global_id % 2 = 0 THEN 't ' || raw_id ELSE '' END AS text FROM nodes"),
)
def entity_text_file(spark, sf_dir):
    """Entity records written as JSON lines and read back; absent texts read as empty."""
    path = _path(spark, "entities")
    nodes = graph(spark, sf_dir).nodes.withColumn("text", F.expr("case when global_id % 2 = 0 then concat('t ', raw_id) end"))
    nodes.select("global_id", "local_id", "node_type", "raw_id", "name", "text", "source").write.json(path)
    return readers.read_entity_texts(spark, path, lines=True).select("global_id", "name", "text")


@query(
    "attached_ids",
    expect("nodes", "SELECT raw_id, global_id, 'x' || name AS note FROM nodes WHERE local_id % 2 = 0"),
)
def attached_ids(spark, sf_dir):
    """Rows keyed by raw id get the global one; keys that are no node are left out."""
    nodes = graph(spark, sf_dir).nodes
    keyed = nodes.selectExpr("if(local_id % 2 = 0, raw_id, concat('no ', raw_id)) as raw_id", "concat('x', name) as note")
    return ident.attach_global_id(keyed, nodes)


@query(
    "repeated_ids",
    expect("nodes", "SELECT node_type || '::' || (local_id % 7) AS raw_id, count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) > 1"),
)
def repeated_ids(spark, sf_dir):
    """Raw ids that name several nodes once ids are cut to their remainder by seven."""
    return ident.duplicate_ids(graph(spark, sf_dir).nodes.withColumn("raw_id", F.expr("concat(node_type, '::', local_id % 7)")))


@query("path_pairs", expect("pt_random", "SELECT drug, disease, count(*) AS n FROM pt_random GROUP BY ALL"))
def path_pairs(spark, sf_dir):
    return path_to_pair(triplets(spark, sf_dir, "random")).groupBy("drug", "disease").agg(F.count("*").alias("n"))


@query("first_rows", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def first_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("less", -F.col("c_acctbal"))
    return preview(rows, ["less", "c_custkey"], 12).select("c_custkey", "c_name")


@query(
    "typed_names",
    "SELECT DISTINCT c_name || ' x' AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def typed_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("concat(c_name, '   x ') as name", "c_mktsegment as type")
    return tab.unique_names(rows, type_value="BUILDING")


@query(
    "phase_rows",
    """SELECT o_orderkey AS row_id, o_orderstatus AS status, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN CAST(substr(o_orderpriority, 1, 1) AS INT) ELSE -1 END AS phase FROM orders""",
)
def phase_rows(spark, sf_dir):
    """Order rows as if their priority were part of a file name."""
    orders = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    file = F.when(digit.isin("1", "2", "3"), F.concat(F.lit("OT_Phase "), digit, F.lit(".csv"))).otherwise(F.lit("other.csv"))
    return readers.union_phase_files(orders, {"o_orderkey": "row_id", "o_orderstatus": "status"}, file)


@query(
    "phase_files",
    """SELECT o_orderkey AS row_id, o_orderstatus AS status, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN CAST(substr(o_orderpriority, 1, 1) AS INT) ELSE -1 END AS phase FROM orders""",
)
def phase_files(spark, sf_dir):
    """Order rows in tables named after their priority, read back as one."""
    base = _path(spark, "phases")
    orders = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    paths = {f"{base}/OT_Phase {d}.csv": digit == d for d in "123"} | {f"{base}/other.csv": ~digit.isin("1", "2", "3")}
    for path, rows in paths.items():
        writers.write_table(orders.filter(rows).select("o_orderkey", "o_orderstatus"), path, "csv")
    schema = "o_orderkey bigint, o_orderstatus string"
    return readers.union_phase_files(
        spark.read.csv(list(paths), header=True, schema=schema), {"o_orderkey": "row_id", "o_orderstatus": "status"})


@query(
    "run_metrics",
    """SELECT CAST(o_orderkey AS VARCHAR) AS file, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN o_totalprice / 2 ELSE o_totalprice / 4 END AS value
  FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 10 = 0""",
)
def run_metrics(spark, sf_dir):
    """One result document per order; the metric stands at different depths and spellings, or nowhere."""
    price = F.col("o_totalprice")
    text = [(price / k).cast("string") for k in (1, 2, 4)]
    body = (
        F.when(F.col("o_orderkey") % 10 == 0, F.lit('{"other":{"hit_at_1":1},"metrics":{"mrr":2}}'))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit('{"runs":[{"ho_eval":{"metrics":{"Hit@1":'), text[0], F.lit('}}}],"metrics":{"hit_at_1":1e9}}')))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit('{"a":{"b":{"metrics":{"HO-Hit@1":'), text[1], F.lit(',"mrr":3}}}}')))
        .otherwise(F.concat(F.lit('{"ho_eval":{"hit at 1":null,"HIT-AT-1":'), text[2], F.lit("}}")))
    )
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("file"), body.alias("value"))
    return readers.select_run_metric(files, "hit_at_1", ["ho_hit_at_1"], on_missing="null")


@query(
    "mapping_rows",
    """SELECT lower(o_orderpriority) AS source, arg_max(t, k) AS target FROM (
  SELECT o_orderpriority, 0 AS k, 'status ' || lower(arg_min(o_orderstatus, o_orderkey)) AS t FROM orders GROUP BY o_orderpriority
  UNION ALL SELECT o_orderpriority, 1, 'late ' || min(o_orderkey) FROM orders GROUP BY o_orderpriority) GROUP BY ALL""",
)
def mapping_rows(spark, sf_dir):
    """Priorities mapped in two spellings; per spelling the first row counts, then the later spelling."""
    orders = table(spark, sf_dir, "orders")
    first = orders.selectExpr("concat(' ', o_orderpriority) as source", "concat('Status  ', o_orderstatus) as target", "o_orderkey as ord")
    last = orders.selectExpr("lower(o_orderpriority) as source", "concat('late ', o_orderkey) as target", "1000000000000 + o_orderkey as ord")
    return readers.normalize_mapping(first.unionByName(last))


@query(
    "selected_paths",
    "SELECT l_orderkey AS drug, l_partkey AS gene, l_suppkey AS pathway, l_linenumber::BIGINT AS disease FROM lineitem",
)
def selected_paths(spark, sf_dir):
    """A table without path column names: its first four integer columns are taken."""
    return readers.select_paths(table(spark, sf_dir, "lineitem"))


@query(
    "missing_smiles",
    """SELECT count(*) AS total, count(*) FILTER (WHERE c_acctbal < 1000) AS missing FROM customer""",
)
def missing_smiles(spark, sf_dir):
    value = F.expr("case when c_acctbal < 0 then null when c_acctbal < 500 then ' ERROR' when c_acctbal < 1000 then '' else c_name end")
    return tab.status_counts(table(spark, sf_dir, "customer"), {"missing": is_missing_smiles(value)})


@query("vector_rows", "SELECT vec_id AS key, len(embedding) AS dim FROM embeddings")
def vector_rows(spark, sf_dir):
    """Vectors written as float arrays, read back with their common length checked."""
    path = _path(spark, "vectors")
    writers.write_vectors(table(spark, sf_dir, "embeddings").selectExpr("vec_id as key", "embedding as vec"), path)
    rows = readers.read_vectors(spark.read.parquet(path), ["key"])
    dim = ve.validate_dims(rows)
    return rows.select("key", F.lit(dim).alias("dim"))
