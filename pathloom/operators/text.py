"""Entity texts: aggregation, graph context, blocklists and composition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.graph import normalize_relation
from ..functions.text import base_text, chunks, compose_text, join_segments, segments, strip, token_text, tokens
from ..lineage import materialize
from ..schema import DIRECT_RELATIONS, DISEASE, DRUG, GENE, PATHWAY
from .phrases import phrase_hits

# --- fixed values: text segments as (column, label, cap, separator), in output order ---
ENTITY_SEGMENTS = {
    "drug": (
        ("trade_names", "trade names", 8, ", "),
        ("synonyms", "synonyms", 12, ", "),
        ("drug_type", "drug type", 4, ", "),
        ("mechanism_of_action", "mechanism of action", 4, "; "),
        ("status", "open targets status", 4, ", "),
    ),
    "target": (
        ("approved_name", "approved names", 4, "; "),
        ("target_name", "target names", 4, "; "),
        ("target_class", "target classes", 6, ", "),
    ),
    "disease": (
        ("ancestors", "ancestors", 4, "; "),
        ("status", "open targets statuses", 4, ", "),
    ),
}
PHASE_LABEL = "max clinical phase in open targets"

# (label, source type, relation, target type, which end receives the neighbour)
CONTEXT_RULES = (
    ("targets", DRUG, "targets", GENE, "src"),
    ("targeted by drugs", DRUG, "targets", GENE, "dst"),
    ("associated genes", DISEASE, "disease_protein", GENE, "src"),
    ("associated diseases", DISEASE, "disease_protein", GENE, "dst"),
    ("interacts with", GENE, "protein_protein", GENE, "src"),
    ("pathways", GENE, "in_pathway", PATHWAY, "src"),
    ("related pathways", PATHWAY, "pathway_pathway", PATHWAY, "src"),
)
# --- end of fixed values ---


def _sentence(parts: Column) -> Column:
    """Non-null segments joined as sentences; empty text for none."""
    kept = F.array_compact(parts)
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, ". "), F.lit("."))).otherwise(F.lit(""))


def entity_text_aggregate(
    df: DataFrame, key: str, specs: Sequence[tuple[str, str, int, str]], order: str, phase: str | None = None
) -> DataFrame:
    """(key, text): the first distinct chunks of each column, capped per segment.

    Repeated cells collapse to their first row before they are parsed, repeated
    chunks to their first position before the cap, and the cap is applied before
    anything is collected.
    """
    cells = [F.struct(F.lit(n).alias("seg"), F.col(c).cast("string").alias("cell")) for n, (c, _, _, _) in enumerate(specs)]
    distinct = (
        df.select(key, order, F.inline(F.array(*cells)))
        .filter("cell is not null")
        .groupBy(key, "seg", "cell")
        .agg(F.min(order).alias("_first"))
    )
    exploded = distinct.select(key, "seg", "_first", F.posexplode(chunks("cell")).alias("pos", "piece"))
    first = exploded.groupBy(key, "seg", "piece").agg(F.min(F.struct("_first", "pos")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy(key, "seg").orderBy("_at", "piece"))
    caps = F.element_at(F.array(*[F.lit(cap) for _, _, cap, _ in specs]), F.col("seg") + 1)
    most = max(cap for _, _, cap, _ in specs)
    kept = first.withColumn("_r", rank).filter(F.col("_r") <= most).filter(F.col("_r") <= caps)
    lists = kept.groupBy(key).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("seg") == n, F.struct("_r", "piece")))).alias(f"_s{n}")
            for n in range(len(specs))
        ]
    )
    texts = [
        F.when(
            F.size(f"_s{n}") > 0,
            F.concat(F.lit(f"{label}: "), F.array_join(F.transform(F.col(f"_s{n}"), lambda s: s["piece"]), sep)),
        )
        for n, (_, label, _, sep) in enumerate(specs)
    ]
    if phase is None:
        return lists.select(key, _sentence(F.array(*texts)).alias("text")).filter("text <> ''")
    phases = df.groupBy(key).agg(F.max(F.col(phase).cast("int")).alias("_phase"))
    texts.append(F.when(F.col("_phase") >= 0, F.concat(F.lit(f"{PHASE_LABEL}: "), F.col("_phase").cast("string"))))
    return phases.join(lists, key, "left").select(key, _sentence(F.array(*texts)).alias("text")).filter("text <> ''")


def top_neighbors(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node_id, label, rank, neighbour): first ``k`` distinct names by neighbour id."""
    kept = edges.filter(~normalize_relation("rel").isin(*DIRECT_RELATIONS))
    cells = []
    for n, (_, src, rel, dst, end) in enumerate(CONTEXT_RULES):
        node, other = ("src_id", "dst_id") if end == "src" else ("dst_id", "src_id")
        rule = (F.col("src_type") == src) & (F.col("rel") == rel) & (F.col("dst_type") == dst)
        cells.append(
            F.when(rule, F.struct(F.lit(n).alias("label_no"), F.col(node).alias("node_id"), F.col(other).alias("other_id")))
        )
    links = kept.select(F.inline(F.array_compact(F.array(*cells))))
    names = nodes.select(F.col("global_id").alias("other_id"), F.trim("name").alias("neighbour"))
    named = links.join(names, "other_id").filter("neighbour <> ''")
    first = named.groupBy("node_id", "label_no", "neighbour").agg(F.min("other_id").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("node_id", "label_no").orderBy("_at", "neighbour"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("node_id", "label_no", "rank", "neighbour")


def graph_context(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(global_id, text): neighbour names under up to seven labels in fixed order."""
    top = top_neighbors(edges, nodes, k)
    lists = top.groupBy(F.col("node_id").alias("global_id")).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("label_no") == n, F.struct("rank", "neighbour")))).alias(f"_l{n}")
            for n in range(len(CONTEXT_RULES))
        ]
    )
    texts = [
        F.when(
            F.size(f"_l{n}") > 0,
            F.concat(F.lit(f"{rule[0]}: "), F.array_join(F.transform(F.col(f"_l{n}"), lambda s: s["neighbour"]), ", ")),
        )
        for n, rule in enumerate(CONTEXT_RULES)
    ]
    return lists.select("global_id", _sentence(F.array(*texts)).alias("text"))


def name_phrases(nodes: DataFrame, node_type: str) -> DataFrame:
    """Distinct normalised names usable as blocklist phrases.

    A name that is one token of at most two characters is too short to match on.
    """
    words = tokens("name")
    usable = (F.size(words) > 1) | ((F.size(words) == 1) & (F.length(words[0]) > 2))
    return nodes.filter((F.col("node_type") == node_type) & usable).select(token_text("name").alias("phrase")).distinct()


def flag_phrases(df: DataFrame, text: str, phrases: DataFrame, out: str = "hit") -> DataFrame:
    """Add whether any phrase occurs in the row's whole text (``phrases.phrase_hits``)."""
    # rows are told apart by a number written with them; keys may be null or repeated
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    norm = token_text(text)
    texts = numbered.select(F.col("_row").alias("row"), F.lit("").alias("side"), norm.alias("norm")).filter("norm <> ''")
    hits = phrase_hits(materialize(texts, "words"), phrases.select(F.lit("").alias("side"), "phrase"))
    return numbered.join(hits.withColumn("_hit", F.lit(True)), F.col("_row") == F.col("row"), "left").select(
        *df.columns, F.coalesce("_hit", F.lit(False)).alias(out)
    )


def _without_phrases(df: DataFrame, text: str, side: Column, phrases: DataFrame) -> DataFrame:
    """Rows of ``df`` without the sentences of ``text`` that hold a phrase of their side; a null side is only trimmed."""
    numbered = materialize(df.withColumns({"_own": F.monotonically_increasing_id(), "_side": side}), "texts")
    cut = numbered.filter("_side is not null").select("_own", "_side", F.posexplode(segments(text)).alias("_pos", "_piece"))
    cut = materialize(cut.withColumns({"row": F.monotonically_increasing_id(), "norm": token_text("_piece")}), "pieces")
    hits = phrase_hits(cut.select("row", F.col("_side").alias("side"), "norm").filter("norm <> ''"), phrases)
    kept = cut.join(hits, "row", "left_anti").groupBy("_own").agg(F.sort_array(F.collect_list(F.struct("_pos", "_piece"))).alias("_kept"))
    cleaned = kept.select(F.col("_own").alias("_o"), join_segments(F.transform("_kept", lambda p: p["_piece"])).alias("_clean"))
    return numbered.join(cleaned, F.col("_own") == F.col("_o"), "left").withColumn(
        text, F.when(F.col("_side").isNull(), strip(text)).when(F.col(text).isNotNull(), F.coalesce("_clean", F.lit("")))
    ).select(*df.columns)


def clean_sentences(df: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """Rows of ``df`` with the sentences of ``text`` that hold a phrase removed."""
    return _without_phrases(df, text, F.lit(""), phrases.select(F.lit("").alias("side"), "phrase"))


def sanitize_texts(df: DataFrame, text: str, drug_phrases: DataFrame, disease_phrases: DataFrame) -> DataFrame:
    """Drop sentences naming the opposite side: diseases for drugs, genes and
    pathways; drugs for diseases. Texts of other types are only trimmed."""
    kind = F.col("node_type")
    side = F.when(kind.isin(DRUG, GENE, PATHWAY), F.lit(DISEASE)).when(kind == DISEASE, F.lit(DRUG))
    both = disease_phrases.select(F.lit(DISEASE).alias("side"), "phrase").unionByName(drug_phrases.select(F.lit(DRUG).alias("side"), "phrase"))
    return _without_phrases(df, text, side, both)


def sanitize_base(cleaned: Column, node_type: Column) -> Column:
    """Cleaned base text without its last full stop; ``<type> entity`` if nothing is left."""
    bare = F.trim(F.regexp_replace(F.trim(cleaned), r"[.]$", ""))
    return F.when(bare != "", bare).otherwise(F.concat(node_type, F.lit(" entity")))


def entity_text_table(
    nodes: DataFrame,
    rich: DataFrame,
    context: DataFrame,
    strategy: str = "hybrid",
    type_prefix: bool = True,
) -> DataFrame:
    """One text per node out of its name, rich text and graph context, sanitised.

    ``rich`` and ``context`` are (global_id, text).
    """
    drugs, diseases = name_phrases(nodes, DRUG), name_phrases(nodes, DISEASE)
    base = nodes.select("global_id", "node_type", base_text("name", "node_type", type_prefix).alias("text"))
    # one row per (node, part), so that every part is matched in the same pass
    parts = base.withColumn("part", F.lit("base"))
    for name, df in (("rich", rich), ("graph", context)):
        typed = df.select("global_id", "text").join(nodes.select("global_id", "node_type"), "global_id")
        parts = parts.unionByName(typed.withColumn("part", F.lit(name)))
    cleaned = sanitize_texts(parts, "text", drugs, diseases)
    wide = cleaned.groupBy("global_id").agg(
        *[F.max(F.when(F.col("part") == p, F.col("text"))).alias(f"_{p}") for p in ("base", "rich", "graph")]
    )
    cleaned = nodes.join(wide, "global_id").withColumn("_base", sanitize_base(F.col("_base"), F.col("node_type")))
    text, source = compose_text(strategy, F.col("_base"), F.col("_rich"), F.col("_graph"))
    return cleaned.select(
        "global_id", "local_id", "node_type", "raw_id", "name", text.alias("text"), source.alias("source"),
        (F.coalesce("_rich", F.lit("")) != "").alias("has_rich"),
        (F.coalesce("_graph", F.lit("")) != "").alias("has_context"),
    )


def text_coverage(texts: DataFrame) -> DataFrame:
    """Per node type: nodes and the share with rich text and with graph context."""
    return texts.groupBy("node_type").agg(
        F.count("*").alias("n_nodes"),
        F.avg(F.col("has_rich").cast("double")).alias("rich_coverage"),
        F.avg(F.col("has_context").cast("double")).alias("context_coverage"),
    )


def source_counts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("source").agg(F.count("*").alias("n_nodes"))
