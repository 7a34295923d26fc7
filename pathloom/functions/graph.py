"""Node-type, relation and path-column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DIRECT_RELATIONS, DISEASE, DRUG, DUMMY_PATHWAY, GENE, NODE_TYPE_ALIASES, PATHWAY


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_node_type(col: Column | str) -> Column:
    """Canonical node type; a type outside the alias map is only trimmed."""
    raw = F.trim(_c(col))
    aliases = F.create_map(*[F.lit(x) for kv in NODE_TYPE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, F.translate(F.lower(raw), "_", "/")), raw)


# --- fixed values: affix patterns in the order they are removed ---
RELATION_AFFIXES = {
    "plain": ("__reverse__$", "^rev_", "^reverse_"),
    "batch": ("__reverse__$", "_reverse$", "^rev_", "^reverse_"),
    "sampler": ("^rev_", "__reverse__$", "_reverse$"),
}
# --- end of fixed values ---


def normalize_relation(col: Column | str, variant: str = "plain") -> Column:
    """Relation name without the affixes that mark a reversed edge.

    ``sampler`` keeps surrounding blanks and the ``reverse_`` prefix; the other
    variants trim first.
    """
    out = _c(col) if variant == "sampler" else F.trim(_c(col))
    for affix in RELATION_AFFIXES[variant]:
        out = F.regexp_replace(out, affix, "")
    return out


def joins_types(left: str, right: str) -> Column:
    """Edge predicate: endpoints have these two types, in either direction."""
    src, dst = F.col("src_type"), F.col("dst_type")
    return ((src == left) & (dst == right)) | ((src == right) & (dst == left))


def orient_pair(edges: DataFrame, left: str, right: str, names: tuple[str, str]) -> DataFrame:
    """Edges between two types as (left id, right id, rel), whatever their direction."""
    forward = F.col("src_type") == left
    return edges.filter(joins_types(left, right)).select(
        F.when(forward, F.col("src_id")).otherwise(F.col("dst_id")).alias(names[0]),
        F.when(forward, F.col("dst_id")).otherwise(F.col("src_id")).alias(names[1]),
        "rel",
    )


def is_direct_relation(
    relations: Sequence[str] = DIRECT_RELATIONS,
    variant: str = "plain",
    edge_types: Sequence[tuple[str, str, str]] | None = None,
) -> Column:
    """Edge predicate: a clinical drug-disease link, or one of an explicit type list."""
    if edge_types is not None:
        hits = [
            (F.col("src_type") == s) & (F.col("rel") == r) & (F.col("dst_type") == d) for s, r, d in edge_types
        ]
        out = F.lit(False)
        for hit in hits:
            out = out | hit
        return out
    return joins_types(DRUG, DISEASE) & normalize_relation("rel", variant).isin(*relations)


def classify_edge_type() -> Column:
    """direct_leakage (any drug-disease type), mechanistic (a gene or pathway end) or other."""
    touches = F.col("src_type").isin(GENE, PATHWAY) | F.col("dst_type").isin(GENE, PATHWAY)
    return (
        F.when(joins_types(DRUG, DISEASE), F.lit("direct_leakage")).when(touches, F.lit("mechanistic")).otherwise("other")
    )


def edge_type_label() -> Column:
    return F.concat_ws("|", "src_type", "rel", "dst_type")


def safe_type_name(col: Column | str) -> Column:
    """Type name usable in a file name."""
    return F.translate(_c(col), "/ -", "___")


def blank_pathway(paths: DataFrame) -> DataFrame:
    """Hide the pathway column; rows are not merged."""
    return paths.withColumn("pathway", F.lit(DUMMY_PATHWAY).cast("bigint"))


def path_to_pair(paths: DataFrame) -> DataFrame:
    return paths.select("drug", "disease")


def entity_label(known: Column, name: Column, raw_id: Column, node_type: Column, global_id: Column) -> Column:
    """What an audit prints for an entity: its fields, or its bare id if it is not known."""
    fields = [F.concat(F.lit(f"{n}="), F.coalesce(F.nullif(c, F.lit("")), F.lit("UNKNOWN"))) for n, c in
              (("name", name), ("raw_id", raw_id), ("node_type", node_type))]
    return F.when(known, F.concat_ws(" | ", *fields)).otherwise(F.concat(F.lit("id="), global_id.cast("string")))


def pair_label(drug: Column, drug_name: Column, disease: Column, disease_name: Column) -> Column:
    """What an audit prints for a pair of ids; a name that is not known shows its id."""
    def shown(name: Column, i: Column) -> Column:
        return F.coalesce(name, F.concat(F.lit("<unknown:"), i.cast("string"), F.lit(">")))

    return F.concat(F.lit("Drug: ["), shown(drug_name, drug), F.lit("] | Disease: ["), shown(disease_name, disease), F.lit("]"))
