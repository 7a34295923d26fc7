"""Shared pieces: columns that any documents table has, and safe numbering of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import materialize

ROWS_PER_SLICE = 20_000

# The word class of the contract, as a Java regular expression.
NOT_A_WORD = "[\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), NOT_A_WORD), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is evaluated once, while a repeated expression inside a
    higher-order function would be evaluated for every element.
    """
    return F.transform(F.array(value), body)[0]


def number_in_groups(df: DataFrame, group: str, order: Column, ties: Sequence[str], out: str) -> DataFrame:
    """Number the rows of each group 0..n-1 by (order, ties); ``{out}_n`` is n.

    ``order`` is uniform in [0, 1). Groups are cut into slices of that range, as
    many as the whole table needs at ROWS_PER_SLICE rows, so a group that holds
    a third of all rows is spread like the rest. Two narrow shuffles; the table
    of slice totals is at most (number of groups) x (number of slices) rows.
    Null is a group of its own. Columns named ``_slice`` or ``_order`` must not exist.
    """
    slices = max(1, -(-df.count() // ROWS_PER_SLICE))
    cut = df.withColumn("_order", order).withColumn("_slice", F.floor(F.col("_order") * slices).cast("int"))
    totals = cut.groupBy(group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select(
        F.col(group).alias("_g"), F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias(f"{out}_n"),
    ), "offsets")
    ranked = cut.withColumn(
        "_r", F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_order", *ties)) - 1
    )
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s"))
    return ranked.join(offsets, same).select(
        *df.columns, (F.col("_before") + F.col("_r")).cast("bigint").alias(out), F.col(f"{out}_n").cast("bigint")
    )


MAP_BITS = 1 << 26  # 8 MB, whatever the number of keys
_MAP_ROW = 1 << 15  # bits of one row of the map


def probably_in(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` whose ``key`` may be among the values ``name`` of ``wanted``; none of these is missed.

    Hashes of the values set bits of a map of fixed size, which tasks build together and every task gets, so wide
    rows that are not wanted need not be moved to find the others. A join must follow. With more
    values than bits the map lets every row through.
    """
    place = F.pmod(F.xxhash64(F.col(name).cast("bigint")), F.lit(MAP_BITS))
    bits = wanted.select(F.floor(place / _MAP_ROW).cast("int").alias("_row"), (place % _MAP_ROW).alias("_at")).groupBy("_row").agg(
        F.bitmap_construct_agg("_at").alias("_bits")
    )
    bits = materialize(bits, "map")  # at most MAP_BITS / _MAP_ROW rows of 4 KB
    own = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(MAP_BITS))
    marked = rows.withColumns({"_own": F.floor(own / _MAP_ROW).cast("int"), "_at": (own % _MAP_ROW).cast("int")})
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)).cast("int") % 2
    return marked.join(F.broadcast(bits), F.col("_own") == F.col("_row")).filter(bit == 1).select(*rows.columns)
