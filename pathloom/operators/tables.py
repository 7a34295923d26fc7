"""Keyed clean-up of external tables: keep-first, merging, patching, resuming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_spaces, comma_items, is_missing_text, safe_text
from ..schema import DRUG
from .checks import require_rows
from .ordered import CHUNK_BYTES, text_chunks


def _extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick, count: str | None) -> DataFrame:
    """One row per key by ``min_by``/``max_by``: combined map-side, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    aggs = [pick(F.struct(*rest), F.struct(*order)).alias("_row")]
    if count:
        aggs.append(F.count("*").alias(count))
    out = df.groupBy(*keys).agg(*aggs)
    cols = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    return out.select(*cols, *([count] if count else []))


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: str | None = None) -> DataFrame:
    return _extreme(df, keys, order, F.min_by, count)


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: str | None = None) -> DataFrame:
    return _extreme(df, keys, order, F.max_by, count)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def drop_null_rows(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required columns as trimmed strings; rows with a null or empty one are dropped."""
    cleaned = df.withColumns({c: F.trim(F.col(c).cast("string")) for c in required})
    return cleaned.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in required]))


def filter_by_type(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose type reads exactly ``value``; none at all is an error."""
    return require_rows(df.filter(F.col(column).cast("string") == value), f"the part of type {value}")


def unique_names(df: DataFrame, name: str = "name", type_column: str | None = "type", type_value: str = DRUG) -> DataFrame:
    rows = filter_by_type(df, type_column, type_value) if type_column else df
    return rows.select(collapse_spaces(name).alias("name")).filter("name <> ''").distinct().orderBy("name")


def merge_records(sources: Sequence[DataFrame]) -> DataFrame:
    """(id, name) over ordered sources: the first name that is present wins.

    Each source has columns ``id``, ``name`` and ``ord``, its row order.
    """
    ranked = [
        s.select(
            F.trim(F.col("id").cast("string")).alias("id"),
            safe_text("name", None).alias("name"),
            F.lit(i).alias("source_rank"),
            "ord",
        )
        for i, s in enumerate(sources)
    ]
    union = reduce(DataFrame.unionByName, ranked).filter("id is not null and id <> ''")
    order = F.when(F.col("name").isNotNull(), F.struct("source_rank", "ord"))
    return union.groupBy("id").agg(F.min_by("name", order).alias("name"), F.count("*").alias("n_records"))


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).cast("bigint").alias("total_records"),
        F.count("*").alias("unique_ids"),
        F.count("name").alias("valid_names"),
        F.count_if(F.col("name").isNull()).alias("invalid_names"),
    )


def first_non_empty(column: str, order: str) -> Column:
    """Aggregate: first text in row order that is not a spelling of nothing."""
    return F.coalesce(
        F.min_by(F.trim(F.col(column).cast("string")), F.when(~is_missing_text(column), F.col(order))), F.lit("")
    )


def _first_pieces(df: DataFrame, key: str, pieces: Column, order: str) -> DataFrame:
    """(key, _piece, _at): each distinct piece with its first place; a piece repeated by many rows is reduced to it."""
    exploded = df.select(key, order, F.posexplode(pieces).alias("_pos", "_piece"))
    return exploded.groupBy(key, "_piece").agg(F.min(F.struct(order, "_pos")).alias("_at"))


def merge_non_empty_chunks(df: DataFrame, key: str, pieces: Column, order: str, most: int = CHUNK_BYTES) -> DataFrame:
    """(key, chunk, text): as ``merge_non_empty_texts``, for keys whose text may not fit a row."""
    first = _first_pieces(df, key, pieces, order).withColumn("_place", F.struct("_at", "_piece"))
    return text_chunks(first, [key], "_place", "_piece", ", ", most)


def merge_non_empty_texts(df: DataFrame, key: str, pieces: Column, order: str, out: str) -> DataFrame:
    """Per key, the distinct pieces in first-seen order, joined by ``, ``.

    ``pieces`` is an array column. The text of a key is one row; ``merge_non_empty_chunks`` bounds it.
    """
    first = _first_pieces(df, key, pieces, order)
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_piece")))
    return first.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["_piece"]), ", ").alias(out))


def comma_pieces(column: str) -> Column:
    return F.when(is_missing_text(column), F.array().cast("array<string>")).otherwise(comma_items(column))


def best_entity_text(candidates: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Most readable alias per entity: no ``::``, not a number, longest."""
    t = F.trim(F.col(text))
    numeric = F.translate(t, ".", "").rlike(r"^\d+$")
    score = F.struct(t.contains("::").alias("p"), numeric.alias("n"), (-F.length(t)).alias("l"), t.alias("t"))
    return candidates.filter(t != "").groupBy(*keys).agg(F.min_by(t, score).alias("name"))


def attach_static(drugs: DataFrame, mapping: DataFrame, prefix: str = "drug::") -> DataFrame:
    """Left join of a static table keyed by the bare id; ``NOT_FOUND`` on a miss."""
    keyed = mapping.select(F.concat(F.lit(prefix), F.trim("static_id")).alias("node_id"), "smiles", "ord")
    first = dedup_keep_first(keyed, ["node_id"], ["ord"]).drop("ord")
    return drugs.join(first, "node_id", "left").withColumn("smiles", F.coalesce("smiles", F.lit("NOT_FOUND")))


def match_counts(df: DataFrame) -> DataFrame:
    missing = F.col("smiles").isNull() | F.col("smiles").isin("NOT_FOUND", "ERROR")
    return df.agg(F.count("*").alias("total"), F.count_if(~missing).alias("matched"), F.count_if(missing).alias("missing"))


def patch_missing(df: DataFrame, patches: DataFrame, key: str = "name") -> DataFrame:
    """Values from ``patches(name, smiles, ord)`` replace those of any row with the name.

    Unresolved patch rows are ignored; the last resolved one per name wins.
    """
    valid = patches.filter(~F.coalesce(F.col("smiles"), F.lit("")).isin("NOT_FOUND", "ERROR")).select(
        F.trim(F.col(key).cast("string")).alias("_key"), F.trim("smiles").alias("_patched"), "ord"
    )
    last = dedup_keep_last(valid, ["_key"], ["ord"]).drop("ord")
    return (
        df.withColumn("_key", F.trim(F.col(key).cast("string")))
        .join(last, "_key", "left")
        .withColumn("smiles", F.coalesce("_patched", "smiles"))
        .select(*df.columns)
    )


# --- fixed values: statuses that need no second attempt ---
TERMINAL_STATUSES = ("FOUND", "NOT_FOUND")
# --- end of fixed values ---


def resume_pending(names: DataFrame, results: DataFrame) -> DataFrame:
    """Names without a terminal status among earlier results.

    ``results`` has ``name``, ``ord`` and ``status`` or, in its absence, the
    value column ``smiles`` to infer the status from.
    """
    if "status" in results.columns:
        status = F.upper(F.trim(F.coalesce(F.col("status").cast("string"), F.lit("nan"))))
    elif "smiles" in results.columns:
        value = F.trim(F.coalesce(F.col("smiles").cast("string"), F.lit("nan")))
        status = F.when((value != "") & ~value.isin("ERROR", "NOT_FOUND"), F.lit("FOUND")).otherwise(value)
    else:
        status = F.lit("FOUND")
    seen = results.select(collapse_spaces("name").alias("name"), status.alias("status"), "ord").filter("name <> ''")
    done = seen.groupBy("name").agg(F.max_by("status", "ord").alias("status"))
    return names.join(done.filter(F.col("status").isin(*TERMINAL_STATUSES)), "name", "left_anti")


def thick_entity_table(base: DataFrame, context: DataFrame, definitions: DataFrame) -> DataFrame:
    """Base entities with context label, ancestors and definition; absent text is empty."""
    joined = base.join(context, "id", "left").join(definitions, "id", "left")
    name = safe_text("name")
    return joined.select(
        "id",
        F.when(name == "", safe_text("label")).otherwise(name).alias("name"),
        safe_text("ancestors").alias("ancestors"),
        safe_text("definition").alias("definition"),
    )


def missingness_profile(df: DataFrame) -> DataFrame:
    """Null and empty counts of every column, one row per column."""
    aggs = []
    for c in df.columns:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"null_{c}"),
            F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"empty_{c}"),
        ]
    one = df.agg(F.count("*").alias("n_rows"), *aggs)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"null_{c}").alias("nulls"), F.col(f"empty_{c}").alias("empties"))
        for c in df.columns
    ]
    return one.select("n_rows", F.inline(F.array(*cells)))


# --- fixed values: share of ids that decides the pattern ---
ID_PATTERN_SHARE = 0.95
# --- end of fixed values ---


def id_pattern(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Share of numeric and alphanumeric id suffixes and the pattern they imply."""
    suffix = F.regexp_replace(F.trim(F.col(column)), r"(?s)^.*::", "")
    ratios = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys)
        .agg(
            F.avg(suffix.rlike(r"^\d+$").cast("double")).alias("numeric_ratio"),
            F.avg(suffix.rlike("^[A-Za-z0-9._-]+$").cast("double")).alias("alnum_ratio"),
        )
    )
    return ratios.withColumn(
        "pattern",
        F.when(F.col("numeric_ratio") > ID_PATTERN_SHARE, F.lit("numeric"))
        .when(F.col("alnum_ratio") > ID_PATTERN_SHARE, F.lit("alphanumeric"))
        .otherwise("mixed"),
    )


def status_counts(df: DataFrame, statuses: Mapping[str, Column]) -> DataFrame:
    """One-row accounting of a featurising job: total plus rows per status."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in statuses.items()])
