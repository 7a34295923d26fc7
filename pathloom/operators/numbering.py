"""Distributed row numbers, ranks and prefix sums.

An unpartitioned window would pull the whole table into one task. Everything
here works on slices of bounded size plus a table of slice totals whose row
count is bounded by ``rows / rows_per_task`` or by the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keyed import HASH_SPACE
from ..lineage import materialize

ROWS_PER_TASK = 1_000_000


def number_globally(df: DataFrame, order: Sequence[str], out: str = "rank", start: int = 0) -> DataFrame:
    """Number rows from ``start`` in the order of columns that identify a row.

    A range shuffle sorts the table; the sorted table is written once so that
    counting its partitions and numbering its rows see the same ranges.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranged = materialize(ranged, "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # one row per partition of the sorted table
    return ranged.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_row") + F.lit(start)).cast("bigint").alias(out)
    )


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    hash_col: str,
    ties: Sequence[str],
    out: str = "idx",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number each group's rows 0..n-1 by (hash, ties), n of the group as ``{out}_n``.

    A group larger than ``rows_per_task`` is cut into slices of its hash range,
    so no task sorts more than about that many rows. The numbers do not depend
    on the slicing.
    """
    keys = list(keys)
    fraction = F.col(hash_col).cast("double") / F.lit(HASH_SPACE)
    if keys:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > rows_per_task)
        hot = sizes.withColumn("_slices", F.ceil(F.col("_size") / F.lit(rows_per_task)).cast("bigint"))
        all_small = hot.isEmpty()
        # at most rows / rows_per_task groups can be this large
        sized = df if all_small else df.join(F.broadcast(hot), keys, "left")
    else:
        n = df.count()
        all_small = n <= rows_per_task
        sized = df.withColumns({"_size": F.lit(n), "_slices": F.lit(-(-n // rows_per_task))})
    if all_small:
        group = Window.partitionBy(*(keys or [F.lit(0)]))
        return df.select(
            "*",
            (F.row_number().over(group.orderBy(hash_col, *ties)) - 1).cast("bigint").alias(out),
            F.count("*").over(group).alias(f"{out}_n"),
        )
    sliced = sized.withColumn(
        "_slice", F.coalesce(F.floor(fraction * F.col("_slices")).cast("bigint"), F.lit(0).cast("bigint"))
    )
    slice_keys = [*keys, "_slice"]
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.filter(F.col("_slices").isNotNull()).groupBy(*slice_keys).agg(F.count("*").alias("_n"))
    # one row per slice of a large group
    offsets = totals.select(*slice_keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    in_slice = Window.partitionBy(*slice_keys)
    numbered = sliced.withColumn("_rn", F.row_number().over(in_slice.orderBy(hash_col, *ties)) - 1).withColumn(
        "_in_slice", F.count("*").over(in_slice)
    )
    return numbered.join(F.broadcast(offsets), slice_keys, "left").select(
        *df.columns,
        (F.coalesce("_offset", F.lit(0)) + F.col("_rn")).cast("bigint").alias(out),
        F.coalesce("_size", "_in_slice").cast("bigint").alias(f"{out}_n"),
    )


SKETCH_SIZE = 8_192  # of a KLL sketch: ranks are known to about 0.07 percent
MOST_BUCKETS = 10_000  # of one group, no more than the sketch can tell apart


def _cut_points(df: DataFrame, value: str, groups: Sequence[str], rows_per_bucket: int) -> DataFrame:
    """(groups as ``_g_*``, cuts): sorted boundaries inside each group that is larger than a bucket.

    Every large group has a sketch of its own, merged where its rows are counted, so groups
    with ranges far apart are cut alike; at most rows / rows_per_bucket groups are that large.
    """
    keys = [F.col(g).alias(f"_g_{g}") for g in groups]
    number = F.nanvl(F.col(value), F.lit(None))
    sized = df.filter(number.isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_bucket)
    sized = materialize(sized, "large")
    largest = sized.agg(F.max("_n")).first()[0]
    if largest is None:
        return sized.select(*[f"_g_{g}" for g in groups], F.array().cast("array<double>").alias("cuts"))
    numbers, theirs = df.filter(number.isNotNull()).select(*keys, value), sized.select(*[F.col(f"_g_{g}").alias(f"_l_{g}") for g in groups], "_n")
    of_large = numbers.join(theirs, _same([f"_g_{g}" for g in groups], [f"_l_{g}" for g in groups])) if groups else (
        numbers.withColumn("_n", sized.scalar()))
    sketch = F.kll_sketch_agg_double(F.when(F.abs(value) < float("inf"), F.col(value)), F.lit(SKETCH_SIZE))
    sketches = of_large.groupBy(*[f"_g_{g}" for g in groups]).agg(sketch.alias("_k"), F.max("_n").alias("_n"))
    # ranks must be literals: those the largest group needs, of which a smaller one takes every so manieth
    most = min(MOST_BUCKETS, -(-largest // rows_per_bucket))
    ranks = F.expr("array(" + ", ".join(f"{i / most!r}D" for i in range(1, most)) + ")")
    stride = F.greatest(F.floor(most * rows_per_bucket / F.col("_n")), F.lit(1))
    every = F.filter(F.kll_sketch_get_quantile_double("_k", ranks), lambda _, i: (i + 1) % stride == 0)
    cuts = F.array_sort(F.array_distinct(every))
    has = F.kll_sketch_get_n_double("_k") > 0  # a group of infinities alone has no cut
    return materialize(sketches.filter(has).select(*[f"_g_{g}" for g in groups], cuts.alias("cuts")), "cuts")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of key columns; true for none."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def place(cuts: Column, value: Column) -> Column:
    """How many of the sorted cut points are not above a value, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(cuts, middle) <= value
        narrowed = F.struct(F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle).alias("hi"))
        return F.when(s["lo"] < s["hi"], narrowed).otherwise(s)

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1.0)).cast("int") + 1)
    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def value_buckets(df: DataFrame, value: str, groups: Sequence[str], rows_per_bucket: int, out: str = "_bucket") -> DataFrame:
    """Order-preserving bucket number of a numeric column inside its group, near-equal in size.

    Equal values always share a bucket. Null comes before all buckets, NaN after them.
    """
    groups = list(groups)
    cuts = _cut_points(df, value, groups, rows_per_bucket)
    joined = df.join(cuts, _same(groups, [f"_g_{g}" for g in groups]), "left") if groups else df.withColumn("cuts", cuts.scalar())
    bucket = F.when(F.col("cuts").isNull(), 0).otherwise(place(F.col("cuts"), F.col(value)))
    marked = F.when(F.col(value).isNull(), -1).when(F.isnan(value), (1 << 31) - 1).otherwise(bucket)
    return joined.select(*df.columns, marked.cast("int").alias(out))


def prefix_sums(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    groups: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``{c}_before``: per group, the sum of ``c`` over strictly smaller values.

    ``df`` holds one row per (group, value), ``value`` being DOUBLE, and is read
    several times: pass a written table. Null is smaller than every number, NaN
    larger; a null group is a group. The values of a group with more rows than half
    of ``rows_per_task`` are cut into buckets of about that many, at quantiles of the group's own
    sketch, and totals of buckets are summed first; a small group is one bucket of numbers.
    """
    groups = list(groups)
    bucketed = value_buckets(df, value, groups, max(1, rows_per_task // 2))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_bucket").alias("_b"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{c}") for c in sums])
    same = F.col("_bucket") == F.col("_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(offsets, same).select(
        *df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_before") for c in sums]
    )


def lower_median(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Lower middle number per group, without holding a group in one task; null and NaN are no numbers."""
    groups = list(groups)
    number = F.col(value).cast("double")
    counts = materialize(
        df.filter(number.isNotNull() & ~F.isnan(number)).groupBy(*groups, F.col(value).cast("double").alias(value)).agg(F.count("*").alias("_n")), "counts"
    )
    ranked = prefix_sums(counts, value, ["_n"], groups)
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    joined = ranked.join(totals, groups) if groups else ranked.withColumn("_total", totals.scalar())
    middle = F.ceil(F.col("_total") / 2)
    hit = (F.col("_n_before") < middle) & (F.col("_n_before") + F.col("_n") >= middle)
    return joined.filter(hit).select(*groups, F.col(value).alias("median"))
