"""Common table expressions in which the expected results are written."""

from __future__ import annotations

SEED = 42


def h(seed: int | str, *cols: str) -> str:
    """SQL for the keyed hash of columns."""
    text = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {text})), 1, 15))::BIGINT"


def score(*cols: str) -> str:
    """SQL for a pseudo-score with many ties, between -2 and 2."""
    return f"(({h('score', *cols)} % 1000)::DOUBLE / 250::DOUBLE - 2::DOUBLE)"


def tokens(col: str) -> str:
    return f"array_to_string(regexp_extract_all(lower({col}), '[a-z0-9]+'), ' ')"


def _sizes(source: str) -> str:
    """Largest-remainder sizes and running ends of the four splits for a row count."""
    return f"""
    SELECT split, ord, coalesce(sum(size) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
           sum(size) OVER (ORDER BY ord) AS hi
    FROM (SELECT split, ord, base + CASE WHEN place <= total - sum(base) OVER () THEN 1 ELSE 0 END AS size
          FROM (SELECT *, row_number() OVER (ORDER BY rem DESC, f DESC, ord) AS place
                FROM (SELECT split, ord, f, total, floor(total * f)::BIGINT AS base, total * f - floor(total * f) AS rem
                      FROM (VALUES ('train', 0, 0.7::DOUBLE), ('valid', 1, 0.1::DOUBLE), ('test', 2, 0.1::DOUBLE), ('ot', 3, 0.1::DOUBLE)) v(split, ord, f),
                           (SELECT count(*) AS total FROM {source}))))"""


def _entity_split(entity: str) -> str:
    return f"""
    SELECT z.split, p.drug, p.disease FROM pairs p
    JOIN (SELECT {entity}, row_number() OVER (ORDER BY {h(SEED, entity)}, {entity}) - 1 AS rn
          FROM (SELECT DISTINCT {entity} FROM pairs)) e USING ({entity})
    JOIN sizes_{entity} z ON e.rn >= z.lo AND e.rn < z.hi"""


def _pair_triplets(splits: str) -> str:
    return f"SELECT s.split, s.drug, t.gene, s.disease FROM {splits} s JOIN triplets t USING (drug, disease)"


# name: (names it builds on, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_nodes": (
        (),
        """
    SELECT 0 AS type_rank, s_suppkey AS num, NULL AS txt, 'drug::' || s_suppkey AS raw_id, 'drug' AS node_type, s_name AS name, 'DrugBank' AS source FROM supplier
    UNION ALL SELECT 1, p_partkey, NULL, 'gene/protein::' || p_partkey, 'gene/protein', p_name, 'NCBI' FROM part
    UNION ALL SELECT 2, NULL, v, 'pathway::' || v, 'pathway', v, 'REACTOME' FROM (SELECT p_brand AS v FROM part UNION SELECT p_type FROM part)
    UNION ALL SELECT 3, c_custkey, NULL, 'disease::' || c_custkey, 'disease', c_name, 'MONDO' FROM customer""",
    ),
    "nodes": (
        ("raw_nodes",),
        """
    SELECT row_number() OVER (ORDER BY type_rank, num, txt) AS global_id,
           row_number() OVER (PARTITION BY type_rank ORDER BY num, txt) - 1 AS local_id, raw_id, node_type, name, source FROM raw_nodes""",
    ),
    "raw_edges": (
        (),
        """
    SELECT DISTINCT 'drug::' || l_suppkey AS src, 'drug' AS src_type, 'targets' AS rel, 'gene/protein' AS dst_type, 'gene/protein::' || l_partkey AS dst
      FROM lineitem WHERE l_tax <> 0 AND l_discount > 0.01::DOUBLE
    UNION ALL SELECT DISTINCT 'disease::' || o_custkey, 'disease', 'disease_protein', 'gene/protein', 'gene/protein::' || l_partkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax <> 0 AND l_discount <= 0.01::DOUBLE
    UNION ALL SELECT 'gene/protein::' || p_partkey, 'gene/protein', 'in_pathway', 'pathway', 'pathway::' || v
      FROM (SELECT p_partkey, p_brand AS v FROM part WHERE p_size <= 40 UNION SELECT p_partkey, p_type FROM part WHERE p_size <= 20)
    UNION ALL SELECT DISTINCT 'drug::' || l_suppkey, 'drug',
      CASE l_returnflag WHEN 'A' THEN 'indication' WHEN 'R' THEN 'off-label use' ELSE 'contraindication' END, 'disease', 'disease::' || o_custkey
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax = 0
    UNION ALL SELECT 'gene/protein::' || p_partkey, 'gene/protein', 'protein_protein', 'gene/protein', 'gene/protein::' || (p_partkey - 1) FROM part WHERE p_size > 40 AND p_partkey > 1""",
    ),
    "edges": (
        ("nodes", "raw_edges"),
        """
    SELECT a.global_id AS src_id, src_type, rel, dst_type, b.global_id AS dst_id
    FROM raw_edges JOIN nodes a ON a.raw_id = src JOIN nodes b ON b.raw_id = dst""",
    ),
    "dg": (("edges",), "SELECT src_id AS drug, dst_id AS gene FROM edges WHERE rel = 'targets'"),
    "sg": (("edges",), "SELECT src_id AS disease, dst_id AS gene FROM edges WHERE rel = 'disease_protein'"),
    "gp": (("edges",), "SELECT src_id AS gene, dst_id AS pathway FROM edges WHERE rel = 'in_pathway'"),
    "direct": (("edges",), "SELECT src_id AS drug, dst_id AS disease, rel FROM edges WHERE src_type = 'drug' AND dst_type = 'disease'"),
    "pairs": (("direct",), "SELECT drug, disease, string_agg(rel, ',' ORDER BY rel) AS relations FROM direct GROUP BY ALL"),
    "sizes_random": (("pairs",), _sizes("pairs")),
    "sizes_drug": (("pairs",), _sizes("(SELECT DISTINCT drug FROM pairs)")),
    "sizes_disease": (("pairs",), _sizes("(SELECT DISTINCT disease FROM pairs)")),
    "split_random": (
        ("pairs", "sizes_random"),
        f"""
    SELECT z.split, drug, disease FROM (SELECT drug, disease, row_number() OVER (ORDER BY {h(SEED, 'drug', 'disease')}, drug, disease) - 1 AS rn FROM pairs) p
    JOIN sizes_random z ON rn >= z.lo AND rn < z.hi""",
    ),
    "split_cross_drug": (("pairs", "sizes_drug"), _entity_split("drug")),
    "split_cross_disease": (("pairs", "sizes_disease"), _entity_split("disease")),
    "triplets": (("dg", "sg"), "SELECT drug, gene, disease FROM dg JOIN sg USING (gene)"),
    "quads": (
        ("triplets", "gp"),
        "SELECT drug, gene, coalesce(pathway, 0) AS pathway, disease FROM triplets LEFT JOIN gp USING (gene)",
    ),
    "connected": (("triplets",), "SELECT DISTINCT drug, disease FROM triplets"),
    "pt_random": (("split_random", "triplets"), _pair_triplets("split_random")),
    "pt_cross_drug": (("split_cross_drug", "triplets"), _pair_triplets("split_cross_drug")),
    "pt_cross_disease": (("split_cross_disease", "triplets"), _pair_triplets("split_cross_disease")),
    # clean graph of the cross_disease split: held-out pairs lose their direct edges
    "holdout": (("split_cross_disease",), "SELECT DISTINCT drug, disease FROM split_cross_disease WHERE split IN ('valid', 'test', 'ot')"),
    "clean": (
        ("edges", "holdout"),
        """
    SELECT e.* FROM edges e WHERE NOT (src_type = 'drug' AND dst_type = 'disease'
      AND EXISTS (SELECT 1 FROM holdout x WHERE x.drug = e.src_id AND x.disease = e.dst_id))""",
    ),
    "scored": (
        ("connected", "pairs"),
        f"""
    SELECT drug, disease, {score('drug', 'disease')} AS score, max(label) AS label
    FROM (SELECT drug, disease, 0 AS label FROM connected UNION ALL SELECT drug, disease, 1 FROM pairs) GROUP BY drug, disease""",
    ),
}


def expect(names: tuple[str, ...] | str, body: str) -> str:
    """``body`` with the named expressions, and what they build on, in front."""
    wanted = (names,) if isinstance(names, str) else names
    ordered: list[str] = []

    def include(name: str) -> None:
        for needed in CTES[name][0]:
            include(needed)
        if name not in ordered:
            ordered.append(name)

    for name in wanted:
        include(name)
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered)
    return f"WITH {parts}\n{body}" if parts else body  # a body may begin with ", name AS (...)"
