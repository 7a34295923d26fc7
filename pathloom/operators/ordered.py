"""Ordered pieces of a key, joined in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize

CHUNK_BYTES = 1 << 20


def ordered_chunks(df: DataFrame, keys: Sequence[str], order: str, item: str, weight: str, most: int) -> DataFrame:
    """``df`` with ``chunk``: pieces of a key in order, cut where their running weight passes a multiple of ``most``.

    (keys, order) must identify a row. The table is sorted by ranges, so a key with very many pieces lies in
    several partitions; each sums its own pieces of a key, and sums of partitions say what stands before them. Numbers
    of chunks may have gaps where one piece is heavier than ``most``.
    """
    keys = list(keys)
    ranged = df.select(*keys, order, item, weight).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "ordered")
    totals = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    chunk = F.floor((F.col("_offset") + F.col("_local")) / most).cast("bigint")
    return local.join(offsets, same).select(*keys, order, item, chunk.alias("chunk"))


def text_chunks(df: DataFrame, keys: Sequence[str], order: str, piece: str, sep: str = ", ", most: int = CHUNK_BYTES) -> DataFrame:
    """(keys, chunk, text): pieces of a key in order, joined by ``sep`` in texts that begin less than ``most`` bytes apart.

    Texts of a key joined by ``sep`` in order of their chunk are all its pieces. A text is at most ``most`` bytes and one piece long.
    """
    weighed = df.withColumn("_w", F.octet_length(piece) + len(sep.encode()))
    cut = ordered_chunks(weighed, keys, order, piece, "_w", most)
    listed = F.sort_array(F.collect_list(F.struct(order, piece)))
    return cut.groupBy(*keys, "chunk").agg(F.array_join(F.transform(listed, lambda s: s[piece]), sep).alias("text"))


def list_chunks(df: DataFrame, keys: Sequence[str], item: Sequence[str], most: int, out: str = "items") -> DataFrame:
    """(keys, chunk, items): sorted structs of ``item`` columns of each key, ``most`` to a row but the last."""
    rows = df.withColumns({"_item": F.struct(*item), "_one": F.lit(1).cast("bigint")}).withColumn("_order", F.col("_item"))
    cut = ordered_chunks(rows, keys, "_order", "_item", "_one", most)
    return cut.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("_item")).alias(out))
