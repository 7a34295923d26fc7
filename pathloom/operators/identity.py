"""Node ids, aliases, lookups and edge tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import normalize_node_type
from ..functions.text import id_suffix, normalize_text, numeric_suffix
from ..schema import DISEASE, DRUG, GENE, PATHWAY, QUAD_TYPES
from .checks import assert_empty, duplicate_keys
from .numbering import number_globally


def assign_ids(nodes: DataFrame, order: Sequence[str], start: int = 0) -> DataFrame:
    """Global ids in the stated order, local ids in the same order within a type.

    The local id is the global rank minus the rank of the type's rows that do
    not belong to it, taken from one table of per-type counts when the order
    starts with the type, else from a second numbering.
    """
    numbered = number_globally(nodes, order, "global_id", start)
    if order[0] in ("node_type", "type_rank"):
        first = numbered.groupBy("node_type").agg(F.min("global_id").alias("_first"))
        # one row per node type
        return numbered.join(F.broadcast(first), "node_type").withColumn(
            "local_id", F.col("global_id") - F.col("_first")
        ).drop("_first")
    by_type = number_globally(numbered, ["node_type", "global_id"], "_rank")
    first = by_type.groupBy("node_type").agg(F.min("_rank").alias("_first"))
    return by_type.join(F.broadcast(first), "node_type").withColumn(
        "local_id", F.col("_rank") - F.col("_first")
    ).drop("_first", "_rank")


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    return duplicate_keys(nodes, ["raw_id"])


def assert_unique_ids(nodes: DataFrame) -> None:
    assert_empty(duplicate_ids(nodes), "duplicate node ids")


def explode_aliases(nodes: DataFrame) -> DataFrame:
    """(node_type, alias, global_id): raw id, its suffix and the name, normalised."""
    forms = [normalize_text("raw_id"), normalize_text(id_suffix("raw_id")), normalize_text("name")]
    return nodes.select(
        "node_type", "global_id", F.explode(F.array_distinct(F.array(*forms))).alias("alias")
    ).filter("alias <> ''")


def alias_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique aliases, ambiguous aliases); the latter with one row per candidate."""
    aliases = explode_aliases(nodes)
    counted = aliases.groupBy("node_type", "alias").agg(
        F.count("*").alias("n_candidates"), F.min("global_id").alias("global_id")
    )
    unique = counted.filter("n_candidates = 1").drop("n_candidates")
    many = counted.filter("n_candidates > 1").drop("global_id")
    return unique, aliases.join(many, ["node_type", "alias"])


def source_aliases() -> Column:
    """Aliases under which external tables may name a node, by type."""
    suffix = normalize_text(id_suffix("raw_id"), collapse=True)
    number = numeric_suffix(suffix)
    is_number = suffix.rlike(r"^\d+$")
    plain = number.cast("bigint").cast("string")
    padded = F.lpad(plain, F.greatest(F.lit(7), F.length(plain)), "0")

    def when(cond: Column, *forms: Column) -> Column:
        return F.when(cond, F.array(*forms)).otherwise(F.array().cast("array<string>"))

    basic = F.array(
        normalize_text("raw_id", collapse=True), suffix, normalize_text("name", collapse=True)
    )
    return F.concat(
        basic,
        when((F.col("node_type") == DRUG) & suffix.startswith("db"), F.concat(F.lit("drugbank:"), suffix)),
        when(
            (F.col("node_type") == GENE) & is_number,
            F.concat(F.lit("entrez:"), suffix),
            F.concat(F.lit("ncbi:"), suffix),
        ),
        when(
            (F.col("node_type") == DISEASE) & F.col("source").startswith("MONDO") & is_number,
            F.concat(F.lit("mondo:"), plain),
            F.concat(F.lit("mondo:"), padded),
            F.concat(F.lit("mondo_"), padded),
            F.concat(F.lit("mondo:"), suffix),
        ),
    )


def alias_index_first_wins(nodes: DataFrame) -> DataFrame:
    """(node_type, alias, raw_id, global_id): the first node keeps a shared alias."""
    aliases = (
        nodes.filter(F.col("node_type").isin(DRUG, GENE, DISEASE))
        .select("node_type", "raw_id", "global_id", F.explode(source_aliases()).alias("alias"))
        .filter("alias <> ''")
    )
    return aliases.groupBy("node_type", "alias").agg(
        F.min_by("raw_id", "global_id").alias("raw_id"), F.min("global_id").alias("global_id")
    )


def lookup_entity(values: DataFrame, nodes: DataFrame, value: str = "value") -> DataFrame:
    """Add status ok / missing / ambiguous, the id and the number of candidates.

    ``values`` has a ``node_type`` column besides the text to look up.
    """
    counted = (
        explode_aliases(nodes)
        .groupBy("node_type", "alias")
        .agg(F.count("*").alias("n_candidates"), F.min("global_id").alias("_id"))
    )
    found = values.withColumn("alias", normalize_text(value)).join(counted, ["node_type", "alias"], "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return found.select(
        *values.columns,
        F.when(n == 1, "ok").when(n > 1, "ambiguous").otherwise("missing").alias("status"),
        F.when(n == 1, F.col("_id")).alias("global_id"),
        n.cast("bigint").alias("n_candidates"),
    )


def paths_from_names(
    named: DataFrame, nodes: DataFrame, columns: Sequence[str], types: Mapping[str, str] = QUAD_TYPES
) -> tuple[DataFrame, DataFrame]:
    """Named paths to id paths, and the rejected positions with their reason.

    ``named`` has ``path_index`` and one text column per position. A path with
    any unresolved position is rejected as a whole.
    """
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            normalize_node_type(F.lit(types[c])).alias("node_type"),
            F.col(c).alias("value"),
        )
        for i, c in enumerate(columns)
    ]
    long = named.select("path_index", F.inline(F.array(*cells)))
    looked = lookup_entity(long, nodes)
    ok = F.col("status") == "ok"
    kept = (
        looked.groupBy("path_index")
        .agg(
            F.bool_and(ok).alias("_ok"),
            *[F.max(F.when(F.col("column") == c, F.col("global_id"))).alias(c) for c in columns],
        )
        .filter("_ok")
        .drop("_ok")
    )
    rejected = looked.filter(~ok).select(
        "path_index", "position", F.col("node_type").alias("expected_type"), "value",
        F.col("status").alias("reason"), "n_candidates",
    )
    return kept, rejected


def reject_candidates(rejected: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per candidate id of every ambiguous rejected position."""
    _, ambiguous = alias_index(nodes)
    return (
        rejected.filter("reason = 'ambiguous'")
        .withColumn("alias", normalize_text("value"))
        .join(ambiguous.drop("n_candidates").withColumnRenamed("node_type", "expected_type"), ["expected_type", "alias"])
        .drop("alias")
    )


def unknown_endpoints(raw_edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source or target is no known node."""
    ids = nodes.select("raw_id")
    trimmed = raw_edges.withColumns({c: F.trim(c) for c in ("src_id", "dst_id")})
    bad_src = trimmed.join(ids.withColumnRenamed("raw_id", "src_id"), "src_id", "left_anti")
    bad_dst = trimmed.join(ids.withColumnRenamed("raw_id", "dst_id"), "dst_id", "left_anti")
    return bad_src.unionByName(bad_dst).distinct()


def build_edge_table(
    nodes: DataFrame, raw_edges: DataFrame, add_inverse: bool = False, on_missing: str = "skip"
) -> DataFrame:
    """Edges by global id. ``on_missing='error'`` raises on an unknown endpoint."""
    if on_missing not in ("skip", "error"):
        raise ValueError(f"on_missing must be 'skip' or 'error': {on_missing}")
    if on_missing == "error":
        assert_empty(unknown_endpoints(raw_edges, nodes), "edges to unknown nodes")
    ids = nodes.select("raw_id", "global_id")
    trimmed = raw_edges.withColumns({c: F.trim(c) for c in ("src_id", "src_type", "rel", "dst_type", "dst_id")})
    src = ids.select(F.col("raw_id").alias("src_id"), F.col("global_id").alias("_src"))
    dst = ids.select(F.col("raw_id").alias("dst_id"), F.col("global_id").alias("_dst"))
    edges = trimmed.join(src, "src_id").join(dst, "dst_id").select(
        F.col("_src").alias("src_id"), "src_type", "rel", "dst_type", F.col("_dst").alias("dst_id")
    )
    return edges.unionByName(reverse_edges(edges)) if add_inverse else edges


def reverse_edges(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("dst_id").alias("src_id"),
        F.col("dst_type").alias("src_type"),
        F.concat("rel", F.lit("__reverse__")).alias("rel"),
        F.col("src_type").alias("dst_type"),
        F.col("src_id").alias("dst_id"),
    )


def id_layout(nodes: DataFrame) -> DataFrame:
    """Per type and for the whole table: rows, id range and whether ids are contiguous."""
    def summary(df: DataFrame, label: Column, col: str) -> DataFrame:
        return df.groupBy(label.alias("scope")).agg(
            F.count("*").alias("n"),
            F.min(col).alias("min_id"),
            F.max(col).alias("max_id"),
            (F.count_distinct(col) == F.count("*")).alias("distinct_ids"),
        )

    both = summary(nodes, F.lit("global"), "global_id").unionByName(summary(nodes, F.col("node_type"), "local_id"))
    return both.withColumn(
        "contiguous", F.col("distinct_ids") & (F.col("max_id") - F.col("min_id") + 1 == F.col("n"))
    ).drop("distinct_ids")


def attach_global_id(keyed: DataFrame, nodes: DataFrame, key: str = "raw_id", out: str = "global_id") -> DataFrame:
    """Rows whose key is a known raw id, with its global id."""
    ids = nodes.select(F.col("raw_id").alias(key), F.col("global_id").alias(out))
    return keyed.join(ids, key)


def attach_names(df: DataFrame, nodes: DataFrame, id_column: str, out: str, unknown: str = "Unknown") -> DataFrame:
    names = nodes.select(F.col("global_id").alias(id_column), F.col("name").alias(out))
    return df.join(names, id_column, "left").withColumn(out, F.coalesce(out, F.lit(unknown)))


def path_violations(paths: DataFrame, nodes: DataFrame, dummy: int | None = None) -> DataFrame:
    """Path cells that are null or no node of the position's type.

    ``dummy`` is accepted at the pathway position although it is no node.
    """
    columns = [c for c in QUAD_TYPES if c in paths.columns]
    cells = [
        F.struct(F.lit(c).alias("position"), F.lit(QUAD_TYPES[c]).alias("node_type"), F.col(c).alias("node_id"))
        for c in columns
    ]
    long = paths.select(*columns, F.inline(F.array(*cells)))
    if dummy is not None:
        long = long.filter(~((F.col("node_type") == PATHWAY) & F.coalesce(F.col("node_id") == dummy, F.lit(False))))
    known = nodes.select("node_type", F.col("global_id").alias("node_id"))
    return long.join(known, ["node_type", "node_id"], "left_anti").select(*columns, "position", "node_id")


def validate_paths(paths: DataFrame, nodes: DataFrame, dummy: int | None = None) -> None:
    columns = [c for c in QUAD_TYPES if c in paths.columns]
    if columns not in (["drug", "gene", "disease"], list(QUAD_TYPES)):
        raise ValueError(f"paths must have three or four id columns, got {paths.columns}")
    assert_empty(path_violations(paths, nodes, dummy), "path cells outside their node type")
