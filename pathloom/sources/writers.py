"""Writers. Every table is written by the executors, laid out for pruning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.graph import safe_type_name
from ..schema import SPLIT_MODES


def write_pair_splits(splits: DataFrame, path: str, split_mode: str, overwrite: bool = False) -> None:
    """(split, drug, disease) under ``split_mode=…/split=…``; refuses to replace unless told to."""
    if split_mode not in SPLIT_MODES:
        raise ValueError(f"unknown split mode: {split_mode}")
    tagged = splits.select(F.lit(split_mode).alias("split_mode"), "split", "drug", "disease")
    gathered = tagged.hint("rebalance", "split")  # no file per task and folder
    writer = gathered.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split_mode", "split")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def write_edges(edges: DataFrame, path: str, overwrite: bool = False) -> None:
    """Edge table laid out by edge type, so typed reads prune to their files."""
    gathered = edges.hint("rebalance", "src_type", "rel", "dst_type")
    gathered.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("src_type", "rel", "dst_type").parquet(path)


def write_features_by_type(features: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """(node_type, global_id, vec) partitioned by sanitised type; returns its metadata."""
    tagged = features.withColumn("type_dir", safe_type_name("node_type")).hint("rebalance", "type_dir")
    tagged.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("type_dir").parquet(path)
    return feature_metadata(features)


def feature_metadata(features: DataFrame) -> DataFrame:
    return features.groupBy("node_type").agg(
        F.count("*").alias("n_rows"), F.max("global_id").alias("max_id"), F.max(F.size("vec")).alias("dim")
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Report or table as json, csv (with header) or parquet."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def write_vectors(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.withColumn("vec", F.col("vec").cast("array<float>")).write.mode(
        "overwrite" if overwrite else "errorifexists"
    ).parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Add status rows to earlier results."""
    rows.write.mode("append").parquet(path)


def write_json_list(records: DataFrame, path: str) -> None:
    """Rows as JSON lists of records, one list a file."""
    write_json_rows(records.select(F.to_json(F.struct("*")).alias("entry")), "entry", path)


def write_json_rows(rows: DataFrame, entry: str, path: str) -> None:
    """JSON texts as JSON lists, one list a file."""
    _write_json(rows.select(F.lit(None).cast("string").alias("outer"), F.col(entry).alias("entry")), path, "[", "]")


def write_json_object(entries: DataFrame, path: str) -> None:
    """(key, value) or (outer, key, value), values as JSON text, as JSON objects, one object a file.

    With ``outer`` an object's values are objects themselves, and the rows of one of these stand in one file as far as they lie in one partition.
    """
    nested = "outer" in entries.columns
    outer = F.col("outer") if nested else F.lit(None).cast("string")
    rows = entries.select(outer.alias("outer"), F.concat(_quoted("key"), F.lit(": "), F.col("value")).alias("entry"))
    _write_json(rows.sortWithinPartitions("outer") if nested else rows, path, "{", "}")


def _quoted(column: str):
    return F.regexp_extract(F.to_json(F.struct(F.col(column).alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)


def _write_json(rows: DataFrame, path: str, opening: str, closing: str) -> None:
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outer, count, inside = None, 0, 0

        def line(*text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["value"])

        yield line(opening)
        for batch in batches:
            out = []
            for own, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != outer:
                    if outer is not None:
                        out.append("}")
                        count += 1
                    out.append(("," if count else "") + own + ": {")
                    outer, inside = own, 0
                if own is None:
                    out.append(("," if count else "") + entry)
                    count += 1
                else:
                    out.append(("," if inside else "") + entry)
                    inside += 1
            yield line(*out)
        yield line(*(["}"] if outer is not None else []), closing)

    keyed = rows.withColumn("outer", F.when(F.col("outer").isNotNull(), _quoted("outer")))
    keyed.mapInArrow(lines, "value string").write.text(path)
