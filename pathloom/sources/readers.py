"""Readers. Columns are chosen from headers; no reader samples data for types
unless the format itself carries none and the column must be numeric."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_missing_text, normalize_text, safe_text
from ..lineage import materialize
from ..operators.checks import require_columns
from ..operators.tables import best_entity_text, dedup_keep_first, dedup_keep_last, drop_null_rows
from ..schema import RAW_EDGE_COLUMNS, RAW_NODE_COLUMNS, SPLIT_MODES
from .json_entries import header_key, json_entries, list_entry, object_entry


def read_csv(spark: SparkSession, path: str, sep: str = ",", line_breaks: bool | None = None) -> DataFrame:
    """Delimited text with a header as strings; a leading byte-order mark is ignored.

    ``line_breaks`` says whether quoted fields may hold line breaks; such files
    cannot be read in parts. Unless told, a pass over the lines finds out: a line
    that leaves a quote open has an odd number of them.
    """
    if line_breaks is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        line_breaks = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=line_breaks, encoding="UTF-8")
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def file_position() -> Column:
    """Order of rows as they stand in their files."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _trimmed(df: DataFrame, columns: Sequence[str], table: str, with_position: bool) -> DataFrame:
    require_columns(df, columns, table)
    picked = [F.trim(c).alias(c) for c in columns]
    return df.select(*picked, *([file_position().alias("ord")] if with_position else []))


def read_nodes(spark: SparkSession, path: str, with_position: bool = True) -> DataFrame:
    """Node CSV as (raw_id, node_type, name, source) and ``ord``, the file order."""
    df = _trimmed(read_csv(spark, path), RAW_NODE_COLUMNS, path, with_position)
    return df.withColumnsRenamed({"id": "raw_id", "type": "node_type"})


def read_edges(spark: SparkSession, path: str, with_position: bool = False) -> DataFrame:
    return _trimmed(read_csv(spark, path), RAW_EDGE_COLUMNS, path, with_position)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Table by file suffix: csv, tsv/txt, parquet/pq, json, jsonl/ndjson."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path)
    if suffix in ("tsv", "txt"):
        return read_csv(spark, path, sep="\t")
    if suffix in ("parquet", "pq"):
        return spark.read.parquet(path)
    if suffix == "json":
        return spark.read.json(path, multiLine=True)
    if suffix in ("jsonl", "ndjson"):
        return spark.read.json(path)
    raise ValueError(f"no reader for {path}")


def standardize_columns(df: DataFrame) -> DataFrame:
    """Column names in lower case with ``_`` for every run of other characters."""
    return df.toDF(*[re.sub(r"[^0-9a-zA-Z]+", "_", c.strip()).strip("_").lower() for c in df.columns])


def resolve_column(
    df: DataFrame, candidates: Sequence[str], required: bool = True, explicit: str | None = None
) -> str | None:
    """First candidate present; an explicit name is matched ignoring case."""
    if explicit is not None:
        for c in df.columns:
            if c.lower() == explicit.lower():
                return c
        raise KeyError(f"no column {explicit}; there are {df.columns}")
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise KeyError(f"none of the columns {list(candidates)} among {df.columns}")
    return None


# --- fixed values: accepted column groups of path tables ---
PATH_COLUMN_GROUPS = (
    ("drug", "gene", "pathway", "disease"),
    ("drug_id", "gene_id", "pathway_id", "disease_id"),
    ("drug_global_id", "gene_global_id", "pathway_global_id", "disease_global_id"),
    ("drug", "gene", "disease"),
    ("drug_id", "gene_id", "disease_id"),
    ("drug_global_id", "gene_global_id", "disease_global_id"),
)
PATH_JSON_KEYS = ("paths", "test_paths", "test_ho_paths", "ho_pos_paths", "positive_paths")
# --- end of fixed values ---


def select_paths(df: DataFrame) -> DataFrame:
    """Path columns of a table as BIGINT: a known group, else its leading integer columns."""
    for group in PATH_COLUMN_GROUPS:
        if all(c in df.columns for c in group):
            names = [c.split("_")[0] for c in group]
            return df.select(*[F.col(c).cast("bigint").alias(n) for c, n in zip(group, names, strict=True)])
    integers = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint")]
    for names in (("drug", "gene", "pathway", "disease"), ("drug", "gene", "disease")):
        if len(integers) >= len(names):
            return df.select(
                *[F.col(c).cast("bigint").alias(n) for c, n in zip(integers[: len(names)], names, strict=True)]
            )
    raise ValueError(f"no path columns among {df.columns}")


def _json_paths(spark: SparkSession, path: str) -> DataFrame:
    """(p) of the rows of a JSON list, or of the first of PATH_JSON_KEYS that an object has."""
    entries = json_entries(spark, path, {"{": 2, "[": 1})
    keyed = materialize(entries.select(
        "file", "opener", F.when(F.col("opener") == "{", header_key("header")).alias("key"), list_entry("text", "array<bigint>").alias("p")
    ), "path_rows")
    place = F.array_position(F.array(*[F.lit(k) for k in PATH_JSON_KEYS]), F.col("key"))
    first = keyed.filter(place > 0).groupBy("file").agg(F.min_by("key", place).alias("_key")).withColumnRenamed("file", "_f")
    named = keyed.join(first, (F.col("file") == F.col("_f")) & (F.col("key") == F.col("_key")), "left_semi")
    return keyed.filter("opener = '['").unionByName(named).select("p")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Three- or four-column paths from a table, or from a JSON object of row lists."""
    if path.lower().endswith((".csv", ".tsv")):
        sep = "\t" if path.lower().endswith(".tsv") else ","
        named = read_csv(spark, path, sep)
        if any(all(c in named.columns for c in g) for g in PATH_COLUMN_GROUPS):
            return select_paths(named)
        # integer columns can only be told apart from text by reading them
        return select_paths(spark.read.csv(path, header=True, sep=sep, inferSchema=True))
    if path.lower().endswith(".json"):
        rows = _json_paths(spark, path)
        width = rows.agg(F.min(F.size("p")).alias("lo"), F.max(F.size("p")).alias("hi")).first()
        if width["lo"] != width["hi"] or width["lo"] not in (3, 4):
            raise ValueError(f"paths must all have three or four ids: {path}")
        names = ("drug", "gene", "disease") if width["lo"] == 3 else ("drug", "gene", "pathway", "disease")
        return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])
    return select_paths(read_table(spark, path))


def read_pair_splits(spark: SparkSession, path: str, split_mode: str) -> DataFrame:
    """(split, drug, disease) of one split mode; only its partitions are read."""
    if split_mode not in SPLIT_MODES:
        raise ValueError(f"unknown split mode: {split_mode}")
    df = spark.read.parquet(path)
    require_columns(df, ("split_mode", "split", "drug", "disease"), path)
    return df.filter(F.col("split_mode") == split_mode).select("split", "drug", "disease")


# --- fixed values: column names accepted in mapping tables ---
MAPPING_SOURCES = ("source_id", "from_id", "query_id", "input_id", "ot_id", "source")
MAPPING_TARGETS = ("target_id", "to_id", "mapped_id", "output_id", "target")
# --- end of fixed values ---


def normalize_mapping(pairs: DataFrame) -> DataFrame:
    """(source, target, ord) normalised: the first row per raw source, then the
    last one per normalised source."""
    first = dedup_keep_first(drop_null_rows(pairs, ["source", "target"]), ["source"], ["ord"])
    clean = first.select(
        normalize_text("source", collapse=True).alias("source"), normalize_text("target", collapse=True).alias("target"), "ord"
    ).filter("source <> '' and target <> ''")
    return dedup_keep_last(clean, ["source"], ["ord"]).select("source", "target")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) from a table, a JSON list of records or a JSON object."""
    if path.lower().endswith(".json"):
        rows = materialize(json_entries(spark, path, {"{": 1, "[": 1}).withColumn("ord", F.struct("file", "entry")), "entries")
        pair = object_entry("text", "string")
        pairs = rows.filter("opener = '{'").select(pair["key"].alias("source"), pair["value"].alias("target"), "ord")
        listed = rows.filter("opener = '['").select(list_entry("text", "map<string,string>").alias("m"), "ord")
        # one key per column of the records
        keys = [r["k"] for r in listed.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect()]
        if keys:
            df = standardize_columns(listed.select(*[F.col("m")[k].alias(k) for k in sorted(keys)], F.col("ord")))
            pairs = pairs.unionByName(df.select(
                F.col(resolve_column(df, MAPPING_SOURCES)).alias("source"), F.col(resolve_column(df, MAPPING_TARGETS)).alias("target"),
                "ord"))
        return normalize_mapping(pairs)
    df = read_table(spark, path)
    df = standardize_columns(df.withColumn("ord", F.monotonically_increasing_id()))
    return normalize_mapping(
        df.select(
            F.col(resolve_column(df, MAPPING_SOURCES)).alias("source"),
            F.col(resolve_column(df, MAPPING_TARGETS)).alias("target"),
            "ord",
        )
    )


def read_entity_map(spark: SparkSession, path: str) -> DataFrame:
    """(node_type, global_id, name) from records or from ``{type: {text: id}}``, read in parts."""
    rows = json_entries(spark, path, {"{": 2, "[": 1})
    record = list_entry("text", "struct<global_id:bigint,node_type:string,name:string,text:string>")
    listed = rows.filter("opener = '['").select(record.alias("r")).select(
        F.trim("r.node_type").alias("node_type"), "r.global_id",
        F.coalesce(F.nullif(F.trim("r.name"), F.lit("")), F.trim("r.text")).alias("name"),
    )
    pair = object_entry("text", "bigint")
    typed = rows.filter("opener = '{'").select(header_key("header").alias("node_type"), pair["key"].alias("text"), pair["value"].alias("global_id"))
    best = best_entity_text(typed, ["node_type", "global_id"])
    return listed.unionByName(best.select("node_type", "global_id", "name"))


def read_id_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, mechanism_text) from a JSON object keyed by id; null-likes are empty."""
    entry = object_entry("text", "struct<name:string,mechanism_text:string>")
    out = json_entries(spark, path, {"{": 1}).select(entry.alias("e")).select(
        F.col("e.key").alias("id"), safe_text(F.col("e.value.name")).alias("name"), safe_text(F.col("e.value.mechanism_text")).alias("mechanism_text")
    )
    if out.isEmpty():
        raise ValueError(f"no entries in {path}")
    return out


def union_phase_files(df: DataFrame, renames: dict[str, str], file: Column | None = None) -> DataFrame:
    """Rows of many files with the phase number found in each file's name, -1 for none.

    Of a table that Spark has written the name is its folder's.
    """
    place = F.split(F.replace(F.input_file_name(), F.lit("%20"), F.lit(" ")), "/")
    own = F.element_at(place, -1)
    name = file if file is not None else F.when(own.startswith("part-"), F.element_at(place, -2)).otherwise(own)
    digits = F.regexp_extract(name, r"(?i)phase[_\s]*(\d+)", 1)
    picked = [F.col(c).alias(n) for c, n in renames.items()]
    return df.select(*picked, F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(-1)).alias("phase"))


def read_features_by_type(spark: SparkSession, path: str, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, report): vectors of every type present, and rows against node counts.

    A type without a feature table is reported as ``missing`` and left out.
    """
    features = spark.read.parquet(path)
    counts = nodes.groupBy("node_type").agg(F.count("*").alias("n_nodes"))
    sizes = features.groupBy("node_type").agg(
        F.count("*").alias("n_rows"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim")
    )
    status = (
        F.when(F.col("n_rows").isNull(), "missing")
        .when(F.col("n_nodes").isNull(), "unknown_type")
        .when((F.col("n_rows") != F.col("n_nodes")) | (F.col("min_dim") != F.col("max_dim")), "mismatch")
        .otherwise("ok")
    )
    report = counts.join(sizes, "node_type", "full_outer").withColumn("status", status)
    return features.withColumn("vec", F.col("vec").cast("array<float>")), report


def read_run_metrics(spark: SparkSession, path: str, name: str, aliases: Sequence[str] = (), on_missing: str = "error") -> DataFrame:
    """(file, value) of one metric in nested result files; see ``select_run_metric``. The outermost object or list of a file is read in parts."""
    entries = json_entries(spark, path, {"{": 1, "[": 1})
    pair = object_entry("text", "string")
    in_object = F.col("opener") == "{"
    key = F.when(in_object, pair["key"]).otherwise(F.col("entry").cast("string"))
    value = F.when(in_object, pair["value"]).otherwise(list_entry("text", "string"))
    level = entries.select(
        "file", F.lit(None).cast("string").alias("parent"), key.alias("key"), F.trim(value).alias("text"), F.array("entry").alias("place"))
    files = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file")).distinct()
    return _selected(files, nested_entries(materialize(level, "entries")), name, aliases, on_missing)


# --- fixed values: objects under which a metric may stand ---
METRIC_PARENTS = ("ho_eval", "metrics")
# --- end of fixed values ---


def metric_key(col: Column) -> Column:
    """Spelling under which two names of a metric are the same."""
    out = F.lower(col)
    for old, new in (("-", "_"), ("@", "_at_"), (" ", "_")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def nested_entries(level: DataFrame) -> DataFrame:
    """(file, parent, key, text, place) of the given entries of JSON documents and of all inside them.

    ``place`` orders entries as they stand. Each pass opens one level more.
    """
    found = [level]
    while not level.isEmpty():
        inside = F.when(F.col("text").startswith("{"), F.map_entries(F.from_json("text", "map<string,string>")))
        listed = F.from_json("text", "array<string>")
        numbered = F.transform(listed, lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value")))
        inside = inside.when(F.col("text").startswith("["), numbered)
        opened = level.select("file", F.col("key").alias("parent"), "place", F.posexplode(inside).alias("_i", "_e"))
        level = materialize(opened.select(
            "file", "parent", "_e.key", F.trim("_e.value").alias("text"), F.concat("place", F.array(F.col("_i").cast("bigint"))).alias("place")
        ), "entries")
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def select_run_metric(files: DataFrame, name: str, aliases: Sequence[str] = (), on_missing: str = "error") -> DataFrame:
    """(file, value) of a metric in documents (file, value).

    The metric is a number under one of METRIC_PARENTS at any depth; keys are
    compared in one spelling. The first entry of that name counts, else the only
    one of an alias. More than one alias is an error, and so is a document
    without the metric unless ``on_missing`` is 'null'. Numbers written as text count.
    """
    whole = files.select("file", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("key"),
                         F.trim("value").alias("text"), F.array().cast("array<bigint>").alias("place"))
    return _selected(files, nested_entries(whole), name, aliases, on_missing)


def _selected(files: DataFrame, entries: DataFrame, name: str, aliases: Sequence[str], on_missing: str) -> DataFrame:
    numbers = entries.select(
        "file", "place", metric_key(F.col("key")).alias("key"), metric_key(F.col("parent")).alias("parent"),
        F.col("text").try_cast("double").alias("value"),
    ).filter(F.col("value").isNotNull() & F.col("parent").isin(*METRIC_PARENTS))
    own = F.col("key") == metric_key(F.lit(name))
    other = F.coalesce(reduce(lambda a, b: a | b, [F.col("key") == metric_key(F.lit(a)) for a in aliases], F.lit(False)), F.lit(False))
    found = numbers.groupBy("file").agg(
        F.min_by(F.when(own, F.col("value")), F.when(own, F.col("place"))).alias("_own"),
        F.count_if(other & ~own).alias("_n"), F.max(F.when(other, F.col("value"))).alias("_other"),
    )
    out = materialize(files.select("file").join(found, "file", "left"), "run_metrics")
    clash = out.filter("_own is null and _n > 1").limit(5).collect()
    if clash:
        raise KeyError(f"ambiguous metric {name} in {[r['file'] for r in clash]}")
    out = out.select("file", F.coalesce("_own", "_other").alias("value"))
    absent = [] if on_missing == "null" else out.filter("value is null").limit(5).collect()
    if absent:
        raise KeyError(f"no metric {name} in {[r['file'] for r in absent]}")
    return out


def read_vectors(df: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """(keys, vec) as float vectors; a null text key reads as empty."""
    cols = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) if t == "string" else F.col(k) for k, t in df.dtypes if k in keys]
    out = df.select(*cols, F.col(vec).cast("array<float>").alias("vec"))
    sizes = out.agg(F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
    if sizes["lo"] is None or sizes["lo"] != sizes["hi"]:
        raise ValueError(f"vectors must be present and of one length, found {sizes['lo']} to {sizes['hi']}")
    return out


def read_entity_texts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entity text records from a JSON list, or from JSON lines, which are read in parts; absent text fields read as empty."""
    schema = "global_id bigint, local_id bigint, node_type string, raw_id string, name string, text string, source string"
    df = spark.read.schema(schema).json(path, multiLine=not lines)
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("name", "text", "raw_id")})


def drop_null_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(~reduce(lambda a, b: a | b, [is_missing_text(c) for c in columns]))
