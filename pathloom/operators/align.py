"""Aligning external association tables with the graph's entities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_ratio
from ..functions.text import normalize_text
from ..lineage import materialize
from ..schema import DISEASE, DRUG, GENE
from .identity import alias_index_first_wins
from .paths import join_sliced, shared_genes
from .tables import dedup_keep_first, drop_null_rows

SIDES: Mapping[str, str] = {"drug": DRUG, "target": GENE, "disease": DISEASE}


def clean_associations(df: DataFrame, keys: tuple[str, str], order: str = "ord") -> DataFrame:
    """Associations with both ids present, the first row per id pair."""
    return dedup_keep_first(drop_null_rows(df, keys), keys, [order]).drop(order)


def _name(df: DataFrame, column: str, side: str) -> DataFrame:
    return df.withColumnRenamed(column, f"{column}_{side}") if column in df.columns else df


def bridge_join(drug_target: DataFrame, target_disease: DataFrame) -> DataFrame:
    """Candidate (drug, target, disease) triples through the shared target.

    The target name of the drug side is preferred. Both inputs hold one row per
    id pair, so the triples are distinct without another shuffle. A target with very many associations is cut into slices.
    """
    left = _name(drug_target, "target_name", "l")
    right = _name(target_disease, "target_name", "r")
    joined = join_sliced(left, right, "target_id")
    names = [F.col(c) for c in ("target_name_l", "target_name_r") if c in joined.columns]
    columns = ["drug_id", "target_id", "disease_id"]
    extra = [c for c in ("drug_name", "disease_name") if c in joined.columns]
    out = joined.select(*columns, *extra, *([F.coalesce(*names).alias("target_name")] if names else []))
    return out


def resolve_column_of(triples: DataFrame, side: str, index: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """(id, name) of one side with the resolved raw id.

    Order of attempts: external mapping, the id itself, the name. Only distinct
    (id, name) rows are looked up.
    """
    id_column, name_column = f"{side}_id", f"{side}_name"
    keys = [id_column, *([name_column] if name_column in triples.columns else [])]
    asked = triples.select(*keys).distinct()
    typed = index.filter(F.col("node_type") == SIDES[side]).select("alias", "raw_id")
    attempts: list[Column] = []

    def attempt(df: DataFrame, key: Column, n: int) -> DataFrame:
        found = typed.select(F.col("alias").alias(f"_k{n}"), F.col("raw_id").alias(f"_r{n}"))
        attempts.append(F.col(f"_r{n}"))
        return df.withColumn(f"_k{n}", key).join(found, f"_k{n}", "left")

    looked = asked.withColumn("_id", normalize_text(id_column, collapse=True))
    if mapping is not None:
        # mapping(source, target) is normalised and unique by source
        looked = looked.join(mapping.select(F.col("source").alias("_id"), F.col("target").alias("_m")), "_id", "left")
        looked = attempt(looked, F.col("_m"), 0)
    looked = attempt(looked, F.col("_id"), 1)
    if name_column in keys:
        looked = attempt(looked, normalize_text(name_column, collapse=True), 2)
    return looked.select(*keys, F.coalesce(*attempts).alias(f"kg_{side}"))


def resolve_sides(df: DataFrame, index: DataFrame, sides: Sequence[str], mappings: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``df`` with ``kg_{side}``, the raw id of each side, null where unmapped."""
    df = materialize(df, "associations")
    out = df
    for side in sides:
        resolved = resolve_column_of(df, side, index, (mappings or {}).get(side))
        keys = [c for c in (f"{side}_id", f"{side}_name") if c in df.columns]
        resolved = resolved.select(*[F.col(c).alias(f"_{c}") for c in keys], f"kg_{side}")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
        out = out.join(resolved, same, "left").drop(*[f"_{c}" for c in keys])
    return out


def resolve_entities(
    triples: DataFrame, nodes: DataFrame, mappings: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Triples with the raw id of every side, null where unmapped.

    Moves the triples once a side; where the two association tables are at hand
    use ``align_associations``.
    """
    return resolve_sides(triples, materialize(alias_index_first_wins(nodes), "aliases"), list(SIDES), mappings)


def resolve_associations(
    drug_target: DataFrame, target_disease: DataFrame, nodes: DataFrame, mappings: Mapping[str, DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both association tables with the raw ids of their sides, that of the target as ``_left`` and ``_right``.

    Each association is resolved once, however many triples it is in and however often the tables are read.
    """
    index = materialize(alias_index_first_wins(nodes), "aliases")
    left = resolve_sides(drug_target, index, ("drug", "target"), mappings).withColumnRenamed("kg_target", "_left")
    right = resolve_sides(target_disease, index, ("target", "disease"), mappings).withColumnRenamed("kg_target", "_right")
    return materialize(left, "resolved"), materialize(right, "resolved")


def _names_target(left: DataFrame, right: DataFrame) -> Column:
    """Whether the target of a drug's association shows the drug side's name, and so is resolved by that."""
    if "target_name" in left.columns and "target_name" in right.columns:
        return F.col("target_name").isNotNull()
    return F.lit("target_name" in left.columns or "target_name" not in right.columns)


def align_associations(
    drug_target: DataFrame, target_disease: DataFrame, nodes: DataFrame, mappings: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """The triples of ``bridge_join`` with the raw id of every side, resolved before the join.

    The triples are never shuffled. A target is resolved by the name its triple
    shows: the drug side's, else the disease side's. A target with very many
    associations is cut into slices.
    """
    return join_resolved(*resolve_associations(drug_target, target_disease, nodes, mappings))


def join_resolved(left: DataFrame, right: DataFrame) -> DataFrame:
    """The triples of two tables of ``resolve_associations``."""
    named = "target_name" in left.columns
    left, right = _name(left, "target_name", "l"), _name(right, "target_name", "r")
    joined = join_sliced(left, right, "target_id")
    names = [F.col(c) for c in ("target_name_l", "target_name_r") if c in joined.columns]
    target = F.when(F.col("target_name_l").isNotNull(), F.col("_left")).otherwise(F.col("_right")) if named and len(names) == 2 else (
        F.col("_left") if named or not names else F.col("_right"))
    extra = [c for c in ("drug_name", "disease_name") if c in joined.columns]
    return joined.select(
        "drug_id", "target_id", "disease_id", *extra, *([F.coalesce(*names).alias("target_name")] if names else []),
        "kg_drug", target.alias("kg_target"), "kg_disease",
    )


# Training drugs of a disease at one target that are looked up in a list; more are found by a join.
HITS_PER_ROW = 1_000


def _mapped_sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, kg_target, kg_drug, several) and (source, kg_disease), distinct, from ``resolve_associations``.

    A source is a target id, with the raw id where the disease side names the target. Rows
    of a source join to distinct triples; ``several`` marks raw ids of targets that more than one source stands for.
    """
    def source(tag: Column) -> Column:
        return F.concat(F.length(tag).cast("string"), F.lit(":"), tag, F.col("target_id")).alias("source")

    own = _names_target(left, right)
    plain = F.lit("")
    mine, theirs = left.filter("kg_drug is not null"), right.filter("kg_disease is not null")
    by_left = mine.filter(own & F.col("_left").isNotNull()).select(source(plain), F.col("_left").alias("kg_target"), "kg_drug").distinct()
    asked = mine.filter(~own).select("target_id", "kg_drug").distinct()
    tagged = theirs.filter("_right is not null").join(asked.select("target_id").distinct(), "target_id", "left_semi")
    by_right = asked.join(tagged.select("target_id", "_right").distinct(), "target_id").select(
        source(F.col("_right")), F.col("_right").alias("kg_target"), "kg_drug"
    )
    drugs = materialize(by_left.unionByName(by_right), "drug_sides")
    several = drugs.groupBy("kg_target").agg((F.min("source") != F.max("source")).alias("several"))
    diseases = theirs.select(source(plain), "kg_disease").unionByName(tagged.select(source(F.col("_right")), "kg_disease"))
    return materialize(drugs.join(several, "kg_target"), "drug_sides"), materialize(diseases.distinct(), "disease_sides")


def mapped_triples(left: DataFrame, right: DataFrame, train_pairs: DataFrame | None = None) -> DataFrame:
    """``fully_mapped`` of ``join_resolved``; with ``train_pairs`` marked as ``mark_overlap`` does.

    Both sides become distinct before they are joined, so only triples of targets that several sources stand
    for are compared with each other; the others are never shuffled. Training pairs are expanded through
    their end with fewer sources, and what they share goes to the disease side as lists, long ones as a join.
    """
    drugs, diseases = _mapped_sides(left, right)
    ids = [f"kg_{s}" for s in SIDES]
    if train_pairs is None:
        def triples(of: DataFrame) -> DataFrame:
            return join_sliced(of, diseases, "source").select(*ids)
    else:
        train = train_pairs.select(F.col("kg_drug").alias("drug"), F.col("kg_disease").alias("disease")).distinct()
        hits = materialize(shared_genes(
            train, drugs.select(F.col("kg_drug").alias("drug"), F.col("source").alias("gene")).distinct(),
            diseases.select(F.col("kg_disease").alias("disease"), F.col("source").alias("gene")),
        ).select(F.col("gene").alias("source"), F.col("disease").alias("kg_disease"), F.col("drug").alias("kg_drug")), "hits")
        # a list is gathered only where it is short
        key = ["source", "kg_disease"]
        sizes = hits.groupBy(*key).agg((F.count("*") > HITS_PER_ROW).alias("_long"))
        crowded = materialize(sizes.filter("_long").drop("_long"), "crowded")
        few = hits.join(crowded, key, "left_anti").groupBy(*key).agg(F.collect_list("kg_drug").alias("_hits"))
        listed = materialize(
            diseases.join(crowded.withColumn("_long", F.lit(True)), key, "left").join(few, key, "left"), "disease_sides"
        )
        flags = hits.withColumn("_hit", F.lit(True))

        def triples(of: DataFrame) -> DataFrame:
            short = join_sliced(of, listed.filter("_long is null"), "source").select(
                *ids, F.coalesce(F.array_contains("_hits", F.col("kg_drug")), F.lit(False)).alias("is_overlap")
            )
            long = join_sliced(of, listed.filter("_long").drop("_hits"), "source").join(flags, [*key, "kg_drug"], "left")
            return short.unionByName(long.select(*ids, F.coalesce("_hit", F.lit(False)).alias("is_overlap")))

    return triples(drugs.filter("not several")).unionByName(triples(drugs.filter("several")).distinct())


def name_resolved(aligned: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the graph's own names of resolved ids."""
    for side in SIDES:
        names = nodes.select(F.col("raw_id").alias(f"kg_{side}"), F.col("name").alias(f"kg_{side}_name"))
        aligned = aligned.join(names, f"kg_{side}", "left")
    return aligned


def fully_mapped(aligned: DataFrame) -> DataFrame:
    """Distinct resolved triples."""
    ids = [f"kg_{s}" for s in SIDES]
    return aligned.filter(" and ".join(f"{c} is not null" for c in ids)).select(*ids).distinct()


def mark_overlap(triples: DataFrame, train_pairs: DataFrame | None) -> DataFrame:
    """Flag triples whose (drug, disease) pair is a training pair; without pairs they have their flags already."""
    if train_pairs is None:
        return triples
    train = train_pairs.select("kg_drug", "kg_disease").distinct().withColumn("_hit", F.lit(True))
    return triples.join(train, ["kg_drug", "kg_disease"], "left").select(
        *triples.columns, F.coalesce("_hit", F.lit(False)).alias("is_overlap")
    )


def split_overlap_novel(triples: DataFrame, train_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    marked = mark_overlap(triples, train_pairs)
    return marked.filter("is_overlap").drop("is_overlap"), marked.filter("not is_overlap").drop("is_overlap")


def novelty_report(triples: DataFrame, train_pairs: DataFrame | None = None) -> DataFrame:
    return _novelty(mark_overlap(triples, train_pairs))


def _novelty(marked: DataFrame) -> DataFrame:
    hit = F.col("is_overlap")
    # a pair is a training pair or not, whatever its triples
    by_pair = marked.groupBy("kg_drug", "kg_disease").agg(F.first("is_overlap").alias("is_overlap"), F.count("*").alias("_n"))

    def rows(*of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of[0], F.col("_n")) if of else F.col("_n")), F.lit(0)).cast("bigint")

    return by_pair.agg(
        rows().alias("n_aligned"),
        rows(hit).alias("n_overlap"),
        rows(~hit).alias("n_novel"),
        safe_ratio(rows(hit), rows()).alias("overlap_ratio"),
        safe_ratio(rows(~hit), rows()).alias("novel_ratio"),
        F.count_if(hit).alias("overlap_pairs"),
        F.count_if(~hit).alias("novel_pairs"),
    )


def side_counts(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Per side (its id, n, m): triples of ``join_resolved`` that the id is in, and how many of them have it mapped.

    An association is in as many triples as the other side has associations of its target, so none is formed.
    """
    lefts = left.groupBy("target_id").agg(F.count("*").alias("_n"))
    rights = right.groupBy("target_id").agg(F.count("*").alias("_n"), F.count("_right").alias("_m"))

    def counted(df: DataFrame, side: str, mapped: Column) -> DataFrame:
        return df.groupBy(f"{side}_id").agg(F.sum("_n").alias("n"), F.sum(mapped).alias("m"))

    def of(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.col("_n")).otherwise(F.lit(0))

    own = _names_target(left, right)
    drugs = left.join(rights, "target_id")
    return {
        "drug": counted(drugs, "drug", of("kg_drug")),
        "target": counted(drugs, "target", F.when(own, of("_left")).otherwise(F.col("_m"))),
        "disease": counted(right.join(lefts, "target_id"), "disease", of("kg_disease")),
    }


def mapping_report(aligned: DataFrame, triples: DataFrame | None = None, sides: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Per side and for whole triples: rows, mapped rows, entities and their rates.

    A scope's rows are combined by id before anything moves, so a side costs as
    many rows as it has entities. ``triples`` are the distinct resolved triples, where they are at hand; ``aligned``
    must then hold one row per triple of ids, as ``join_resolved`` gives it, and no triple is moved. With the ``sides`` it was joined from,
    triples are read for their own scope alone, and the scopes of sides are counted on associations.
    """
    aligned = aligned.select(*[c for s in SIDES for c in (f"{s}_id", f"kg_{s}")])
    counted = side_counts(*sides) if sides is not None else {}
    if triples is None:
        aligned = materialize(aligned, "aligned")

    def scope(name: str, sides: Sequence[str]) -> DataFrame:
        ids, kgs = [f"{s}_id" for s in sides], [f"kg_{s}" for s in sides]
        mapped = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in kgs])
        if len(sides) > 1 and triples is not None:
            counts = aligned.agg(F.count("*").alias("n_triples"), F.count_if(mapped).alias("n_mapped"))
            counts = counts.withColumns({"n_entities": F.col("n_triples"), "_hits": F.col("n_mapped")})
        else:
            by_id = counted.get(name)
            if by_id is None:
                by_id = aligned.groupBy(*ids).agg(F.count("*").alias("n"), F.count_if(mapped).alias("m"))
            counts = by_id.agg(
                F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_triples"),
                F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("n_mapped"),
                F.count("*").alias("n_entities"), F.count_if(F.col("m") > 0).alias("_hits"),
            )
        if len(sides) > 1:
            whole = aligned.filter(mapped).select(*kgs).distinct() if triples is None else triples
            counts = counts.withColumn("_kg", whole.agg(F.count("*")).scalar())
        else:
            counts = counts.withColumn("_kg", F.col("_hits"))
        return counts.select(
            F.lit(name).alias("scope"), "n_triples", "n_mapped", safe_ratio(F.col("n_mapped"), F.col("n_triples")).alias("triple_rate"),
            "n_entities", F.col("_kg").alias("n_mapped_entities"), safe_ratio(F.col("_hits"), F.col("n_entities")).alias("entity_rate"),
        )

    parts = [scope(s, [s]) for s in SIDES] + [scope("triple", list(SIDES))]
    return reduce(DataFrame.unionByName, parts).filter("n_triples > 0")


def alignment_report(
    drug_target: DataFrame, target_disease: DataFrame, candidates: DataFrame, triples: DataFrame, train_pairs: DataFrame | None = None
) -> DataFrame:
    """(section, key, value) counts of every stage of the alignment."""
    def rows(df: DataFrame, section: str) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns]
        return df.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))

    marked = mark_overlap(triples, train_pairs)
    if train_pairs is not None:
        marked = materialize(marked, "marked")
    new = marked.filter("not is_overlap")
    novelty = materialize(_novelty(marked), "novelty")  # one row

    def entities(side: str) -> Column:
        return new.select(f"kg_{side}").distinct().agg(F.count("*")).scalar()

    unique = novelty.select(
        *[entities(s).alias(f"{s}s") for s in SIDES], F.col("novel_pairs").alias("pairs")
    )
    stages = (
        (drug_target.agg(F.count("*").alias("drug_target")), "input"),
        (target_disease.agg(F.count("*").alias("target_disease")), "input"),
        (candidates.agg(F.count("*").alias("candidates")), "construction"),
        (novelty, "novelty"),
        (unique, "novel_entities"),
    )
    return reduce(DataFrame.unionByName, [rows(df, section) for df, section in stages])


def training_pairs_from(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct raw-id pairs of pair or path rows given by global or raw ids."""
    out = paths
    for column, name in (("drug", "kg_drug"), ("disease", "kg_disease")):
        if dict(paths.dtypes)[column] == "string":
            out = out.withColumn(name, F.trim(column))
        else:
            ids = nodes.select(F.col("global_id").alias(column), F.col("raw_id").alias(name))
            out = out.join(ids, column)
    return out.select("kg_drug", "kg_disease").filter("kg_drug <> '' and kg_disease <> ''").distinct()
