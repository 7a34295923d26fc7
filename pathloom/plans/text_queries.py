"""Text queries over documents and over the graph's entity texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import text as te
from ..schema import DISEASE, DRUG
from .audit_queries import rounded
from .graph_store import graph, table
from .oracle import expect, tokens
from .registry import query

NEIGHBOURS = 5


@query(
    "segments",
    r"""SELECT doc_id, len(s) AS n_segments, CASE WHEN len(s) > 0 THEN array_to_string(s, '. ') || '.' ELSE '' END AS text FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\s*[.]\s*'), lambda p: trim(p, E' \t\n\r')), lambda p: p <> '') AS s FROM documents)""",
)
def segments(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", tx.segments("text").alias("pieces"))
    return cut.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_segments"), tx.join_segments(F.col("pieces")).alias("text")
    )


@query("tokens", f"SELECT doc_id, {tokens('text')} AS tokens, left(text, 300) AS preview FROM documents")
def doc_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", tx.token_text("text").alias("tokens"), tx.text_preview("text").alias("preview")
    )


@query(
    "chunks",
    """SELECT p_partkey, CASE WHEN p_type = p_name THEN p_type || '~' || p_brand ELSE p_type || '~' || p_brand || '~' || p_name END AS pieces FROM part""",
)
def chunks(spark, sf_dir):
    cells = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "concat('[', p_type, '; ', p_brand, ' | \"', p_name, '\", ', p_type, ';nan;None]') as cell"
    )
    return cells.select("p_partkey", F.array_join(tx.chunks("cell"), "~").alias("pieces"))


@query(
    "list_items",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || '~x' WHEN o_orderstatus = 'P' THEN 'a ' || o_orderpriority || '~b'
  WHEN o_orderkey % 2 = 0 THEN 'Crohn''s ' || o_orderpriority || '~say "x", y~7' ELSE o_orderpriority || '~' || o_orderstatus END AS items FROM orders""",
)
def list_items(spark, sf_dir):
    """Plain cells, sets, lists with quotes inside and tuples."""
    cells = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.format_string("%s , x,%s", "o_orderpriority", "o_orderpriority"))
        .when(F.col("o_orderstatus") == "P", F.format_string("{'a %s', 'b'}", "o_orderpriority"))
        .when(F.col("o_orderkey") % 2 == 0, F.format_string("[\"Crohn's %s\", 'say \\\"x\\\", y', 7, None]", "o_orderpriority"))
        .otherwise(F.format_string("('%s', '%s', 'nan',)", "o_orderpriority", "o_orderstatus")).alias("cell"),
    )
    return cells.select("o_orderkey", F.array_join(tx.list_literal("cell"), "~").alias("items"))


@query(
    "disease_texts",
    """SELECT c_custkey, 'Disease: ' || c_name || '.' || CASE WHEN c_acctbal < 0 THEN '' ELSE ' Classification/Ancestors: ' || c_mktsegment || '.' END ||
  CASE WHEN c_nationkey < 5 THEN '' ELSE ' Definition: ' || n_name || '.' END AS text,
  CASE WHEN c_acctbal < 0 THEN c_name || ' is a medical condition.' ELSE c_mktsegment END AS encoded FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def disease_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("n_nationkey = c_nationkey"))
    ancestors = F.expr("case when c_acctbal < 0 then 'nan' else c_mktsegment end")
    definition = F.expr("case when c_nationkey < 5 then null else n_name end")
    return rows.select(
        "c_custkey",
        tx.disease_text(F.col("c_name"), ancestors, definition, "Classification/Ancestors").alias("text"),
        tx.text_to_encode(F.col("c_name"), ancestors).alias("encoded"),
    )


@query(
    "gene_text",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name ELSE p_brand || ' ' || p_name END || CASE WHEN p_size > 40 THEN '' ELSE '. ' || p_type END || '. ' || p_type || ', ' || p_brand || '. bp ' || p_type AS text FROM part""",
)
def gene_text(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name", "case when p_size < 10 then 'NaN' else p_brand end as symbol",
        "case when p_size > 40 then null else p_type end as summary",
        """concat('[{"term":"', p_type, '"},{"term":"', p_brand, '"},{"term":"', p_type, '"},{"id":1}]') as mf""",
        """concat('{"term":"bp  ', p_type, '"}') as bp""",
    )
    text = tx.gene_text(
        F.col("symbol"), F.col("p_name"), F.col("summary"), tx.go_terms(F.col("mf")), tx.go_terms(F.col("bp")), F.col("p_name")
    )
    return part.select("p_partkey", text.alias("text"))


# --- blocklists ---

_PHRASES = f"""phrases AS (SELECT DISTINCT node_type, phrase, substr(split_part(phrase, ' ', 1), 1, 4) AS prefix FROM (SELECT node_type, {tokens('name')} AS phrase FROM nodes)
    WHERE phrase <> '' AND (phrase LIKE '% %' OR length(phrase) > 2))"""


def _hit(text: str, kind: str) -> str:
    """SQL: some phrase of the node type occurs in the text by the prefix rule."""
    return f"""EXISTS (SELECT 1 FROM phrases ph WHERE ph.node_type = '{kind}' AND contains({tokens(text)}, ph.phrase)
    AND list_contains(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: substr(w, 1, 4)), ph.prefix))"""


_PLANTED = """planted AS (SELECT d.doc_id, d.text || ' ' || CASE WHEN l.quality = 1 THEN coalesce(c_name, '') ELSE 'custom ' || s_name END || ' ' || lang AS text
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN customer ON c_custkey = d.doc_id JOIN (SELECT min(s_name) AS s_name FROM supplier) ON true)"""


@query(
    "blocklist_hits",
    expect("nodes", f""", {_PHRASES}, {_PLANTED},
  matched AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, {tokens('text')} AS tt, list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: substr(w, 1, 4))) AS starts FROM planted) p
    JOIN phrases ph ON ph.node_type = 'disease' AND contains(tt, ph.phrase) AND list_contains(starts, ph.prefix))
  SELECT p.doc_id, m.doc_id IS NOT NULL AS hit FROM planted p LEFT JOIN matched m USING (doc_id)"""),
)
def blocklist_hits(spark, sf_dir):
    """Whole documents, some with an entity name planted at the end, against all disease names."""
    first_supplier = table(spark, sf_dir, "supplier").agg(F.min("s_name")).scalar()
    docs = (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("doc_id"), "left")
    )
    name = F.when(F.col("quality") == 1, F.coalesce("c_name", F.lit(""))).otherwise(F.concat(F.lit("custom "), first_supplier))
    planted = docs.select("doc_id", F.concat("text", F.lit(" "), name, F.lit(" "), "lang").alias("text"))
    names = te.name_phrases(graph(spark, sf_dir).nodes, DISEASE)
    return te.flag_phrases(planted, "text", names).select("doc_id", "hit")


@query("name_phrases", expect("nodes", f", {_PHRASES} SELECT phrase FROM phrases WHERE node_type = 'gene/protein'"))
def name_phrases(spark, sf_dir):
    return te.name_phrases(graph(spark, sf_dir).nodes, "gene/protein")


# --- graph context ---

_CONTEXT = f"""links AS (
    SELECT src_id AS global_id, CASE rel WHEN 'targets' THEN 0 WHEN 'disease_protein' THEN 2 ELSE 5 END AS lab, dst_id AS other FROM edges WHERE rel IN ('targets', 'disease_protein', 'in_pathway')
    UNION ALL SELECT dst_id, CASE rel WHEN 'targets' THEN 1 ELSE 3 END, src_id FROM edges WHERE rel IN ('targets', 'disease_protein')
    UNION ALL SELECT src_id, 4, dst_id FROM edges WHERE rel = 'protein_protein'),
  topn AS (SELECT * FROM (SELECT global_id, lab, neighbour, row_number() OVER (PARTITION BY global_id, lab ORDER BY first_at, neighbour) AS rank FROM (
    SELECT l.global_id, lab, trim(n.name) AS neighbour, min(other) AS first_at FROM links l JOIN nodes n ON n.global_id = other GROUP BY ALL)) WHERE rank <= {NEIGHBOURS}),
  ctx AS (SELECT global_id, string_agg(seg, '. ' ORDER BY lab) || '.' AS text FROM (
    SELECT global_id, lab, CASE lab WHEN 0 THEN 'targets: ' WHEN 1 THEN 'targeted by drugs: ' WHEN 2 THEN 'associated genes: ' WHEN 3 THEN 'associated diseases: ' WHEN 4 THEN 'interacts with: ' ELSE 'pathways: ' END
      || string_agg(neighbour, ', ' ORDER BY rank) AS seg FROM topn GROUP BY global_id, lab) GROUP BY global_id)"""


@query("top_neighbors", expect("edges", f", {_CONTEXT} SELECT global_id AS node_id, lab AS label_no, rank, neighbour FROM topn"))
def top_neighbors(spark, sf_dir):
    g = graph(spark, sf_dir)
    return te.top_neighbors(g.edges, g.nodes, NEIGHBOURS)


@query("graph_context", expect("edges", f", {_CONTEXT} SELECT global_id, text FROM ctx"))
def graph_context(spark, sf_dir):
    g = graph(spark, sf_dir)
    return te.graph_context(g.edges, g.nodes, NEIGHBOURS)


# sentences of a text without those that name the other side
_CLEANED = r"""pieces AS (SELECT global_id, node_type, unnest(list_filter(string_split_regex(text, '\s*[.]\s*'), lambda p: p <> '')) AS piece, unnest(range(len(list_filter(string_split_regex(text, '\s*[.]\s*'), lambda p: p <> '')))) AS pos
    FROM ctx JOIN nodes USING (global_id)),
  marked AS (SELECT p.*, EXISTS (SELECT 1 FROM phrases ph WHERE ph.node_type = CASE WHEN p.node_type = 'disease' THEN 'drug' ELSE 'disease' END AND contains(TOKENS, ph.phrase)
    AND list_contains(list_transform(regexp_extract_all(lower(piece), '[a-z0-9]+'), lambda w: substr(w, 1, 4)), ph.prefix)) AS bad FROM pieces p),
  cleaned AS (SELECT global_id, coalesce(string_agg(piece, '. ' ORDER BY pos) FILTER (WHERE NOT bad) || '.', '') AS text FROM marked GROUP BY global_id)""".replace(
    "TOKENS", tokens("piece")
)


@query("sanitized", expect("edges", f", {_CONTEXT}, {_PHRASES}, {_CLEANED} SELECT global_id, text FROM cleaned"))
def sanitized(spark, sf_dir):
    """Graph contexts without the sentences that name diseases (for diseases: drugs)."""
    g = graph(spark, sf_dir)
    context = te.graph_context(g.edges, g.nodes, NEIGHBOURS).join(g.nodes.select("global_id", "node_type"), "global_id")
    drugs, diseases = te.name_phrases(g.nodes, DRUG), te.name_phrases(g.nodes, DISEASE)
    return te.sanitize_texts(context, "text", drugs, diseases).select("global_id", "text")


# --- rich texts of drugs ---

_LINES = """, lines AS (SELECT l_suppkey + 1 AS global_id, l_orderkey * 10 + l_linenumber AS k, p_brand, p_type, p_name, l_returnflag, l_linestatus, o_orderstatus, l_linenumber
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
  chunked AS (SELECT global_id, 0 AS seg, k, unnest([0, 1]) AS pos, unnest([p_brand, p_type]) AS piece FROM lines
    UNION ALL SELECT global_id, 1, k, 0, p_name FROM lines UNION ALL SELECT global_id, 2, k, 0, l_returnflag FROM lines
    UNION ALL SELECT global_id, 3, k, 0, l_linestatus FROM lines UNION ALL SELECT global_id, 4, k, 0, o_orderstatus FROM lines),
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY global_id, seg ORDER BY first_at, piece) AS r FROM (SELECT global_id, seg, piece, min((k, pos)) AS first_at FROM chunked GROUP BY ALL))
    WHERE r <= CASE seg WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 4 END),
  rich AS (SELECT global_id, string_agg(txt, '. ' ORDER BY seg) || '. max clinical phase in open targets: ' || (SELECT max(l_linenumber) FROM lines x WHERE x.global_id = s.global_id) || '.' AS text FROM (
    SELECT global_id, seg, CASE seg WHEN 0 THEN 'trade names: ' WHEN 1 THEN 'synonyms: ' WHEN 2 THEN 'drug type: ' WHEN 3 THEN 'mechanism of action: ' ELSE 'open targets status: ' END
      || CASE seg WHEN 3 THEN string_agg(piece, '; ' ORDER BY r) ELSE string_agg(piece, ', ' ORDER BY r) END AS txt FROM capped GROUP BY global_id, seg) s GROUP BY global_id)"""


def rich_texts(spark, sf_dir):
    """Rich text per supplier out of everything its order lines say."""
    line, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    rows = (
        line.join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .selectExpr(
            "concat('drug::', l_suppkey) as raw_id",
            "concat(p_brand, '; ', p_type) as trade_names", "p_name as synonyms", "l_returnflag as drug_type",
            "l_linestatus as mechanism_of_action", "o_orderstatus as status", "l_linenumber as phase",
            "l_orderkey * 10 + l_linenumber as ord",
        )
    )
    texts = te.entity_text_aggregate(rows, "raw_id", te.ENTITY_SEGMENTS["drug"], "ord", "phase")
    return graph(spark, sf_dir).nodes.select("raw_id", "global_id").join(texts, "raw_id").select("global_id", "text")


@query("text_aggregate", expect("nodes", _LINES + " SELECT global_id, text FROM rich"))
def text_aggregate(spark, sf_dir):
    return rich_texts(spark, sf_dir)


_ENTITY_TEXTS = f"""{_LINES}, {_CONTEXT}, {_PHRASES}, {_CLEANED},
  et AS (SELECT n.global_id, n.local_id, n.node_type, n.raw_id, n.name, concat_ws(' ', n.node_type || ': ' || trim(n.name), nullif(r.text, ''), nullif(c.text, '')) AS text,
    concat_ws('+', 'name', CASE WHEN coalesce(r.text, '') <> '' THEN 'rich_text' END, CASE WHEN coalesce(c.text, '') <> '' THEN 'graph_context' END) AS source,
    coalesce(r.text, '') <> '' AS has_rich, coalesce(c.text, '') <> '' AS has_context
  FROM nodes n LEFT JOIN rich r USING (global_id) LEFT JOIN cleaned c USING (global_id))"""


def _entity_texts(spark, sf_dir, strategy: str = "hybrid"):
    g = graph(spark, sf_dir)
    context = te.graph_context(g.edges, g.nodes, NEIGHBOURS)
    return te.entity_text_table(g.nodes, rich_texts(spark, sf_dir), context, strategy)


@query("entity_texts", expect(("nodes", "edges"), _ENTITY_TEXTS + " SELECT * FROM et"))
def entity_texts(spark, sf_dir):
    return _entity_texts(spark, sf_dir)


@query(
    "entity_texts_context_only",
    expect(
        ("nodes", "edges"),
        _ENTITY_TEXTS
        + """ SELECT e.global_id, CASE WHEN coalesce(c.text, '') <> '' THEN e.node_type || ': ' || trim(e.name) || '. ' || c.text ELSE e.node_type || ': ' || trim(e.name) END AS text,
  CASE WHEN coalesce(c.text, '') <> '' THEN 'name+graph_context' ELSE 'name_only_fallback' END AS source FROM et e LEFT JOIN cleaned c USING (global_id)""",
    ),
)
def entity_texts_context_only(spark, sf_dir):
    return _entity_texts(spark, sf_dir, "graph_context_only").select("global_id", "text", "source")


@query(
    "text_coverage",
    expect(
        ("nodes", "edges"),
        _ENTITY_TEXTS
        + " SELECT node_type, count(*) AS n_nodes, round(avg(has_rich::INT), 6) AS rich_coverage, round(avg(has_context::INT), 6) AS context_coverage FROM et GROUP BY node_type",
    ),
)
def text_coverage(spark, sf_dir):
    return rounded(te.text_coverage(_entity_texts(spark, sf_dir)), "rich_coverage", "context_coverage")


@query("text_sources", expect(("nodes", "edges"), _ENTITY_TEXTS + " SELECT source, count(*) AS n_nodes FROM et GROUP BY source"))
def text_sources(spark, sf_dir):
    return te.source_counts(_entity_texts(spark, sf_dir))
